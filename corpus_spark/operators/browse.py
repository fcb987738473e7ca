"""Screen reads: filters, orders, pages and capped logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.fixed_values import PAGE_SIZE
from corpus_spark.functions.tiers import sort_rank


def browse(
    facts: DataFrame,
    analysis: DataFrame,
    q: str = "",
    floor: str | None = None,
    verdict: str | None = None,
) -> DataFrame:
    """Facts with their analysis, filtered. The verdict `null` asks for rows not filtered yet."""
    rows = facts.join(analysis, "package", "left")
    if q:
        rows = rows.filter(F.col("package").ilike(f"%{q}%"))
    if floor is not None:
        rows = rows.filter(F.col("floor") == floor)
    if verdict == "null":
        rows = rows.filter(F.col("filter_verdict").isNull())
    elif verdict is not None:
        rows = rows.filter(F.col("filter_verdict") == verdict)
    return rows


def screen_order(rows: DataFrame, sort: str = "device_count", descending: bool = True) -> list:
    key = sort_rank(F.col("floor")) if sort == "floor" else F.col(sort)
    return [key.desc() if descending else key.asc(), F.col("package").asc()]


def page(rows: DataFrame, number: int, total: int, sort: str = "device_count", descending: bool = True, size: int = PAGE_SIZE) -> DataFrame:
    """One page; a number past the end means the last page. `total` is the filtered row count."""
    last = max(1, -(-total // size))
    start = (min(max(1, number), last) - 1) * size
    return rows.orderBy(*screen_order(rows, sort, descending)).offset(start).limit(size)


def newest(rows: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    """The newest rows of a log, with the log's whole size beside each."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(limit).withColumn("total", total)


def ranked(rows: DataFrame) -> DataFrame:
    """Most widely shipped first; a package without facts goes last."""
    return rows.orderBy(F.col("device_count").desc_nulls_last(), F.col("package").asc())
