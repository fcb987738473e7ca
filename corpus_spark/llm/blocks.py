"""Comparing the rows of a group in pairs of blocks, so that a hot group is many small tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a[i], b[i]) of small non-negative numbers: (node, its root)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def in_block_pairs(df: DataFrame, group: list[str], key: str, size: int) -> DataFrame:
    """Every row once per pair of blocks of its group that it takes part in.

    Rows are dealt to ceil(members / size) blocks by a hash of `key`. `side` is 0 for a pair's first
    block, 1 for its second, 2 for a block that meets itself. All pairs of a group's rows share a pair
    of blocks, and a hot group is as many tasks as it has pairs of blocks. Groups of one row go.
    """
    counted = (
        df.groupBy(*group)
        .agg(F.count("*").alias("members"))
        .filter("members > 1")
        .select(*group, F.ceil(F.col("members") / F.lit(size)).alias("blocks"))
    )
    own = F.pmod(F.xxhash64(key), F.col("blocks"))
    pair = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return (
        df.join(counted, group)
        .withColumn("own", own)
        .withColumn("other", pair)
        .withColumn(
            "side",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1),
        )
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("own", "other", "blocks")
    )


def map_groups(
    df: DataFrame, keys: list[str], each: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str
) -> DataFrame:
    """`each(rows, bounds)` over whole groups, many small groups at a time.

    Rows come sorted by `keys`; group i is rows[bounds[i]:bounds[i + 1]]. A call sees the groups that end in
    one Arrow batch, so what is held is one batch and one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.zeros(len(rows), bool)
            for k in keys:
                values = rows[k].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            cuts = np.flatnonzero(new)
            if not len(cuts):
                held = rows
                continue
            yield each(rows.iloc[: cuts[-1]], np.concatenate([[0], cuts]))
            held = rows.iloc[cuts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield each(held, np.array([0, len(held)]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
