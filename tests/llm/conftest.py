import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text[, source]) rows, with a column that clashes with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, n_words int")
    return make


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "some text without an id"), (5, "x " * 30_000),
       (6, "Ünïcödé \x00 \x1c   words 中文 😀 | * #")]


@pytest.fixture
def odd(docs):
    return docs(ODD)
