"""Ordered computations without a single-task window.

A window over the whole table, or over one key that holds a third of it, would sort that group in
one task. Instead rows are range-partitioned on (keys, order) and written once with their slice
number: slices are even whatever the key distribution is, because a hot key spans many of them.
Windows then run per slice, and what crosses a slice border is carried by one summary row per
slice, so what is broadcast is bounded by the number of slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpus_spark.session import materialize


def _order(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def sliced(df: DataFrame, columns: Sequence[str], name: str, slices: int | None = None) -> DataFrame:
    """`df` written in even, ordered slices, with the number of each row's slice."""
    n = slices or max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        df.sparkSession.sparkContext.defaultParallelism,
    )
    ranged = df.repartitionByRange(n, *_order(columns)).withColumn("slice", F.spark_partition_id())
    return materialize(ranged, name)


def running_total(
    df: DataFrame, value: str, order: Sequence[str], alias: str, slices: int | None = None
) -> DataFrame:
    """Adds `alias`, the sum of `value` over all rows before this one, in `order`."""
    rows = sliced(df, order, "running-total", slices)
    per_slice = rows.groupBy("slice").agg(F.sum(value).alias("slice_total"))
    carried = per_slice.select(
        "slice",
        F.coalesce(
            F.sum("slice_total").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("carried"),
    )
    within = W.partitionBy("slice").orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(carried), "slice")  # one row per slice
        .withColumn(alias, F.col("carried") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("slice", "carried")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str, slices: int | None = None
) -> DataFrame:
    """Adds `alias`, the 1-based position of a row among its key's rows, in `order`."""
    rows = sliced(df, [*keys, *order], "numbered", slices)
    counts = rows.groupBy("slice", *keys).agg(F.count(F.lit(1)).alias("n"))
    # Only a slice's last key can continue, so only border keys carry anything: a key that lies in
    # several slices. Keys inside one slice are dropped before anything is broadcast.
    spanning = counts.withColumn("parts", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter("parts > 1")
    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = spanning.select(
        "slice", *keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried")
    )
    within = W.partitionBy("slice", *keys).orderBy(*_order(order))
    return (
        # Two border keys per slice at most.
        rows.join(F.broadcast(carried), ["slice", *keys], "left")
        .withColumn(alias, F.coalesce("carried", F.lit(0)) + F.row_number().over(within))
        .drop("slice", "carried")
    )


def with_neighbour_rows(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Adds `previous_<c>` for `columns` of the key's previous row and `last`, whether a row is the
    key's last one, in `order`. Keys must not be NULL."""
    rows = sliced(df, [key, *order], "neighbour-rows", slices)
    packed = F.struct(*[F.col(c) for c in (key, *columns)])
    ends = rows.groupBy("slice").agg(
        F.max_by(packed, F.struct(*[F.col(c) for c in (key, *order)])).alias("tail"),
        F.min(key).alias("head_key"),
    )
    by_slice = W.orderBy("slice")  # over one row per slice
    borders = ends.select(
        "slice",
        F.lag("tail").over(by_slice).alias("before"),
        F.lead("head_key").over(by_slice).alias("after_key"),
    )
    within = W.partitionBy("slice", key).orderBy(*_order(order))
    back = F.lag(F.struct(*[F.col(c) for c in columns])).over(within)
    carried = F.when(
        F.col("before")[key] == F.col(key), F.struct(*[F.col("before")[c].alias(c) for c in columns])
    )
    position = F.row_number().over(within)
    ahead = F.lead(F.lit(True)).over(within)
    return (
        rows.withColumns({"_back": back, "_position": position, "_ahead": ahead})
        .join(F.broadcast(borders), "slice")
        .withColumn("_previous", F.when(F.col("_position") == 1, carried).otherwise(F.col("_back")))
        .withColumn("last", F.col("_ahead").isNull() & ~F.col("after_key").eqNullSafe(F.col(key)))
        .select(*df.columns, *[F.col("_previous")[c].alias(f"previous_{c}") for c in columns], "last")
    )


def with_last_seen(rows: DataFrame, key: str, order: Sequence[str], marks: Mapping[str, Column]) -> DataFrame:
    """Adds per mark its value at the key's latest earlier row that has one, NULL without such a row: a mark is NULL
    on rows that don't count for it. `rows` come from `sliced` by (key, order); keys must not be NULL.

    All marks share one sort per slice. A slice hands on, per mark, its last key that has a value, and a slice without
    one hands on what came before; so a key may span any number of slices.
    """
    place = F.struct(*[F.col(c) for c in (key, *order)])
    ends = rows.groupBy("slice").agg(
        *[F.max(F.when(value.isNotNull(), F.struct(place.alias("place"), value.alias("value")))).alias(m) for m, value in marks.items()]
    )
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # over one row per slice
    carried = ends.select("slice", *[F.last(m, True).over(before).alias(f"_{m}") for m in marks])
    earlier = W.partitionBy("slice", key).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumns({m: F.last(value, True).over(earlier) for m, value in marks.items()})
        .join(F.broadcast(carried), "slice")  # one row per slice
        .withColumns({m: F.coalesce(m, F.when(F.col(f"_{m}")["place"][key] == F.col(key), F.col(f"_{m}")["value"])) for m in marks})
        .drop(*[f"_{m}" for m in marks])
    )
