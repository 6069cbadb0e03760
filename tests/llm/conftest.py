import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quillspark.session import ship_package

    ship_package(spark)


@pytest.fixture()
def table(spark):
    """DataFrame of documents with columns whose names clash with working names."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumns({"key": F.lit(7), "score": F.lit("x"), "digest": F.lit(1.5), "node": F.lit(None).cast("int"),
                               "start": F.lit(0), "removed": F.lit("r")})

    return make
