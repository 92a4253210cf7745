import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=True):
        """Documents (doc_id, text[, source]) with columns that clash with names the operators use."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", 1.0) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, token_ids string, score double"
        df = spark.createDataFrame(full, schema)
        return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")

    return make
