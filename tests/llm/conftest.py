import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows to table: null and repeated ids, null, empty and blank texts, ties, extra columns with odd names."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, b long, `group` string")

    return make


PROSE = "the quick brown fox jumps over the lazy dog while seven wise men watch from a hill and talk about rain "


@pytest.fixture(scope="session")
def prose():
    return PROSE


@pytest.fixture(scope="session")
def awkward(docs):
    """One table with every awkward case."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    rows = [(1, PROSE * 3), (2, PROSE * 3), (2, PROSE * 3), (2, "other text"), (None, PROSE), (None, PROSE), (None, None), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "Oneaea " * 400), (10, long), (11, "é" * 300), (12, "\n".join([PROSE.strip()] * 4))]
    return docs(rows)
