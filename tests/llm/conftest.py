import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __items string, __kept int, `a.b` double"
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def document(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "clash", "clash", 7, 0.5)


@pytest.fixture
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns whose names clash."""
    rows = [document(1, None), document(2, ""), document(3, " \n\t "), document(4, "word " * 40_000), document(5, "same text here"), document(5, "same text here"), document(None, "no id"), document(7, "żółw 🐢 naïve", None), document(8, "x" * 300_000, "??")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def unchanged(kept, source):
    """Whether every kept row is one of the source's, in all columns."""
    every = {tuple(r) for r in source.collect()}
    return kept.columns == source.columns and all(tuple(r) in every for r in kept.collect())
