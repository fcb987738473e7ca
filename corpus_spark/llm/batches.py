"""How many texts a Python worker holds at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpus_spark.session import ship_package

BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, since a row is a whole text; a smaller setting stays. Workers get the package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
