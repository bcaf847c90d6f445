import pytest

#: Columns that operators use inside; an input may have columns of the same names.
CLASHES = {"cid": "x", "sig": "x", "node": 1, "leaf": 1, "side": 1, "bit": 1, "rep": 1, "pattern": "x", "score": 0.5, "ord": 1, "kept": True, "label": 0, "runs": "x", "items": "x", "ref": "x", "block": 1, "k": 1, "n": 1, "key": "x", "line": "x", "asked": "x"}


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame, with columns that clash with the operators' own."""

    def make(rows, schema, clash=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.lit(v) for c, v in CLASHES.items() if c not in df.columns}) if clash else df

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
