"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two grouped joins over the remaining edges, written to the shared folder so that a lost
executor costs one step. Groups are only ever reduced by `min`, so a hub needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    return (
        both.filter("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): for every node of `edges` (a, b), the smallest node of its component.

    Rows with a null end or equal ends say nothing and are dropped; repeated rows count once. An
    empty table gives an empty one. Nodes without an edge don't appear.
    """
    current = materialize(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-edges",
    )
    state = _state(current)
    while state[0]:
        current = materialize(_small_star(_large_star(current)), f"{name}-stars")
        after = _state(current)
        if after == state:
            break
        state = after
    # Stars now: u points at the smallest node, which itself points nowhere.
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
