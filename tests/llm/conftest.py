import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """Rows to a table with columns that clash with names used inside."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("fp", "block", "shard", "score", "rest", "kind", "source"):
            df = df.withColumn(name, F.lit(1))
        return df.withColumn("lang", F.lit("en")) if "lang" not in df.columns else df
    return make
