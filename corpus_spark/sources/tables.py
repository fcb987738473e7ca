"""Table reads and the three write shapes: column-scoped upsert, replace-by-key, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD = "spark.corpus_spark.spread"


class EmptyInputError(RuntimeError):
    """An operator that needs rows got none; an empty success would hide a skipped stage."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet scan, left to its own splits: how a table is laid out in row groups is its writer's job.

    A table known to be written as one row group may be spread by its leading key column instead: set
    `spark.corpus_spark.spread` to a number of partitions. Unset, which is right for large tables, nothing is moved.
    """
    df = spark.read.parquet(path)
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread), df.columns[0]) if spread else df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """`df` itself, or an error naming the empty input. Reads at most one row."""
    if df.limit(1).isEmpty():
        raise EmptyInputError(f"{what} has no rows: the stage that writes it has not run")
    return df


def require_proposals(classification: DataFrame, proposals: DataFrame) -> DataFrame:
    """Zero live proposals is an error only when nothing was ever classified."""
    if proposals.limit(1).isEmpty():
        require_rows(classification, "package classification")
    return proposals


def upsert_columns(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], insert_only: Sequence[str] = ()
) -> DataFrame:
    """Insert-or-update on `keys`. Only columns of `incoming` are written, `insert_only` ones just
    on insert; every other stored column keeps its value."""
    written = [c for c in incoming.columns if c not in keys]
    left = stored.withColumn("_old", F.lit(True)).alias("o")
    right = incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = left.join(right, list(keys), "full_outer")
    columns = []
    for c in dict.fromkeys([*stored.columns, *incoming.columns]):
        if c in keys:
            columns.append(F.col(c))
        elif c not in written:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c not in stored.columns:
            columns.append(F.col(f"n.{c}").alias(c))
        else:
            wins = F.col("_new") if c not in insert_only else F.col("_new") & F.col("_old").isNull()
            columns.append(F.when(wins, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def replace_by_key(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every stored row of a key the batch names goes, then the batch's rows come in."""
    named = incoming.select(*keys).distinct()
    return stored.join(named, list(keys), "left_anti").unionByName(incoming)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
