import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with the other columns and some of clashing names."""

    def make(rows, source="s"):
        full = [(i, t, "en", source, None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, hit_spans string, Score string")

    return make
