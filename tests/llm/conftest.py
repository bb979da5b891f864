import pytest


@pytest.fixture(autouse=True)
def shipped(spark):
    from petrel.shipping import ship

    ship(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table, with clashing names added if asked for."""

    def make(rows, clash=()):
        df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)
        for c in clash:
            df = df.selectExpr("*", f"'other' AS `{c}`")
        return df

    return make
