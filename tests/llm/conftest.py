import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, copy int, row long, `__row1` long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns that clash with names the operators use."""

    def make(rows):
        full = [(i, text, rest[0] if rest else "en", rest[1] if len(rest) > 1 else "s", None, 1.5, "n", 7, 1, 2) for i, text, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make
