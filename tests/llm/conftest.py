import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, label int, kept string, size string, part string, _row int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(doc_id, text, source), ...]): documents with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, "n", 1, "k", "z", "p", 7) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"w{i}" for i in range(300))
    return make_docs([
        (1, words, "a"), (2, words + " more at the end", "a"), (2, words + " more at the end", "a"), (3, None, "a"), (4, "", None), (5, "   \n ", "b"), (6, "one", "b"),
        (6, "two words", "b"), (None, words, None), (None, None, None), (7, "x " * 30000, "c"), (8, "Ünïcode   straße 漢字 " * 20, "c"), (9, "the line\n" * 40, "c"),
    ])
