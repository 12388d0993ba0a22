import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make documents from (doc_id, text, lang, source) rows."""

    def make(rows):
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, blanks, ties, repeats, a long text."""
    long = " ".join(f"w{i % 977}" for i in range(60000))
    return docs([(1, None, "en", "a"), (2, "", None, None), (3, "  \n\t", "en", "a"), (4, "one", "en", "b"), (5, "one", "de", "b"), (5, "one", "de", "b"), (None, "one two three", None, "c"), (6, long, "fr", None), (7, long + " end", "fr", "a"), (8, "123 !!", "en", "a"), (None, None, None, None)])
