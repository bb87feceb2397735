import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from retentio.session import builder, ensure_checkpoint_dir
    s = builder(master="local[4]", shuffle_partitions=4,
                extra={"spark.driver.memory": "4g"}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
