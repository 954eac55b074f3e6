import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts (ids 0, 1, ...) or from (id, text) pairs, with clashing extra columns on request."""
    def make(texts, extra=""):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS)
        for name in extra.split():
            df = df.withColumn(name, df["source"])
        return df

    return make
