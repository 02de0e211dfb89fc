import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (ids count up) or (id, text) pairs."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(pairs)], DOCS)

    return make


@pytest.fixture(scope="session")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
