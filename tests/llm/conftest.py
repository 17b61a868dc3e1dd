import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text, lang, source) with n_chars and a column whose name operators also make."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "extra") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
