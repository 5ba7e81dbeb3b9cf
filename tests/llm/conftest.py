import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with extra columns whose names clash with results."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, "s", None if t is None else len(t), "x", 7) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, TEXT_SCHEMA)

    return make
