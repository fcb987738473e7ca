"""Report-shaped jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.operators import telemetry as t


def telemetry(jobs: DataFrame, events: DataFrame, holder: DataFrame | None, window_start: str, now: str) -> DataFrame:
    """(section, name, a, b, c): every number of one window in one frame. Jobs are read once, events once."""
    leases = t.lease_stats(events, window_start, now, holder).select(
        F.lit("lease").alias("section"),
        F.lit("all").alias("name"),
        F.col("total_acquisitions").cast("double").alias("a"),
        F.col("occupied_seconds").alias("b"),
        F.col("occupancy_pct").alias("c"),
    )
    return t.job_numbers(jobs, window_start, now).unionByName(leases)
