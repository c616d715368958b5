import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with extra, clashing column names."""

    def make(rows):
        full = [(*r, "x", "s", 1, "y", 2) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, cls int")

    return make
