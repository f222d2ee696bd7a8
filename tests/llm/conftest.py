import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double"


@pytest.fixture
def make(spark):
    """A table of documents, with columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 1, 0.5) for i, t, lang, src in rows], DOCS)

    return build


WORDS = "the of and to in a is that for it was on with as be this by at from or an are not".split()


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    prose = " ".join(WORDS)
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, prose, "en", "a"), (5, prose, "en", None),
        (6, prose + " " + " ".join(f"w{i}" for i in range(30000)), "en", "b"), (4, prose, "en", "a"), (7, "x", None, "b"), (8, "12 !! 34", "de", "b"), (None, "null id", "en", "a"),
    ]
