import pytest

from retentio.llm.tables import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty and one very long text, repeated rows and ids, and a column that clashes with results."""
    rows = [(1, "Licensed under CC BY-NC 4.0. All rights reserved. cc by", "en", "a", 3, "x"),
            (1, "Licensed under CC BY-NC 4.0. All rights reserved. cc by", "en", "a", 3, "x"),
            (None, None, None, None, None, None), (None, "", "en", None, 0, "y"), (4, "", "de", "b", 0, "y"),
            (5, "word " * 40_000 + "GNU General Public License, version 3", "en", "a", 5, "z"),
            (6, "é😀 ÀÉ</s>[INST]\nzwei\nthree four five six seven", "fr", "c", 6, "z"), (7, "\n\n\n", "fr", "", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
