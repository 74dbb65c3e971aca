import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns with clashing names."""
    rows = [(1, "The cat sat on the mat.", "en"), (2, "The cat sat on the mat.", "en"), (2, "The cat sat on the mat.", "en"), (3, None, "en"), (4, "", None),
            (5, "Ein Haus und ein Garten, schön.", "de"), (None, "lonely words here", None), (6, " \t\n ", "de"), (7, "word " * 5000, "en"), (8, "x" * 9000, None), (9, "日本 é 😀\n a  b", "ja")]
    return spark.createDataFrame([(i, t, l, "s", 1.0, "clash") for i, t, l in rows], "doc_id long, text string, lang string, kept string, score double, `_id` string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
