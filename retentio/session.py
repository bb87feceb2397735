"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Folders of sessions that run in one process, by application.
_OWN: dict[str, str] = {}

# Settings that matter for every job of the engine. On a cluster most of these
# come from the cluster config; ``builder`` only fills what is unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE sizes shuffle partitions from the data: ~128 MB each after
    # coalescing, so a high ``spark.sql.shuffle.partitions`` on a cluster
    # costs nothing at small scale and keeps partitions in memory at large.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark 4 captures the Python call site of every Column call for error
    # messages (a stack walk + JVM round trips each); plans here are built
    # from many small expressions, so it is off.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(master: str | None = None, app: str = "retentio", shuffle_partitions: int | None = None,
            extra: dict | None = None) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``)."""
    spark = builder(
        master=f"local[{cores}]",
        shuffle_partitions=cores,
        extra={"spark.driver.memory": memory, "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)},
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


class SharedFolderMissing(RuntimeError):
    """No ``spark.checkpoint.dir`` on a cluster: executors would not see each other's files."""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``, set for checkpoints too.

    A session that runs in one process (``local``, as in tests) may leave it
    unset and gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise SharedFolderMissing(f"set spark.checkpoint.dir to a folder that driver and executors share ({sc.master})")
        current = _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="retentio-ckpt-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current
