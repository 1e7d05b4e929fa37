import pytest

COLUMNS = "doc_id long, text string, row string, key string, bucket long, payload string, _row string, _key string, fp string, component string, at long, near string, kind int, lang string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text), with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(d, t, "r", "k", 1, "p", "u", "v", "f", "c", 2, "n", 3, None, None if t is None else len(t)) for d, t in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank and very long texts, repeated rows, rows without id, bytes of several widths."""
    passage = "The quick brown fox jumps over the lazy dog while the band plays on é ß 猫 and nobody minds at all."
    return [(1, None), (2, ""), (3, " \n\t "), (4, passage), (4, passage), (5, "x " + passage + " y"), (None, passage), (None, None), (6, "word " * 30_000), (7, "word " * 30_000), (8, "é" * 500), (9, "a"), (10, passage + passage)]
