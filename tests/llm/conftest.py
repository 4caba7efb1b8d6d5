import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts: ids count from 0 unless pairs are given."""

    def make(texts):
        rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Texts that every operator must take: null, empty, white space, symbols, long, repeated, odd characters."""
    return [None, "", " \n\t ", "1234 ... !!", "word " * 30_000, "same text here for you", "same text here for you", "naïve Straße İÇ 漢字 ‍ é", "<|endoftext|> a <|startoftext|>b", "x" * 50_000]
