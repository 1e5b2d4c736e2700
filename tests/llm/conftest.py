import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) as documents, with extra columns whose names operators use inside."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t or ""), "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest string, block int, spans string")

    return make


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: takes over half a minute")
