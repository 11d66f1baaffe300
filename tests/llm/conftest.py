import pytest

# Nulls in every column, empty and blank texts, a long text, ties and repeated rows.
ODD_TEXTS = [None, "", " \n\t ", "word", "The same text twice over.\nThe same text twice over.", "a" * 30_000,
             "x y " * 9_000, "Ünïcødé 漢字 🙂 é\x00\x1c\x85 <|endoftext|> it's 'S", "token = abcdefghijkl0123",
             "The same text twice over.\nThe same text twice over."]


@pytest.fixture
def odd_docs(spark):
    """Documents of :data:`ODD_TEXTS`; the extra columns bear names that operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "id", 1, 2) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], (3, "another text under an id used before", None, None, None, None, None, None),
             (None, "a text without an id", None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, rank int, key int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
