import pytest

@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents frame from texts or (id, text) pairs, with clashing extra columns."""

    def make(rows, extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            names = "h node sig set score class label fill root words first key part n rn v id count __id".split()
            df = df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
        return df

    return make
