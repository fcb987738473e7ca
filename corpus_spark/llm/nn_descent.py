"""Approximate nearest neighbours: NN-descent builds a neighbour graph, and queries search it greedily.

Equal vectors are one node. First neighbours come from blocks of rows that are close in a few random orders: a row's
place in an order is the path of sides on which it lies of random hyperplanes. Then rounds of joins improve the graph: the neighbours
of a node, and the nodes it is a neighbour of, are each other's candidates, where at least one of the two is new there. Rounds end
when few neighbours change. What gathers at a node is bounded: its own KEPT neighbours and its REVERSE closest referrers. Later
rounds and the search reach what one round leaves out.

A search holds the BEAM closest nodes seen for every query and, round by round, follows the edges of the closest ones not yet
followed, until all are. It starts from the query's own node, where the table has it, and from the closest of PIVOTS nodes.

The descent measures in half precision, on vectors scaled to at most one; the search measures the original vectors in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpus_spark.llm.blocks import map_groups
from corpus_spark.llm.cross_polytope import rotated
from corpus_spark.session import finished_shuffles_dropped, materialize

KEPT, REVERSE = 32, 24
ORDERS = 4  # the last one is random, which ties far regions together
BLOCK = 64
FOUND_A_BLOCK = 12  # of a row's candidates in one block or around one node, the closest
ROUNDS, SETTLED = 12, 0.03
BEAM, FOLLOWED, PIVOTS = 160, 40, 512


@dataclass
class Graph:
    """`nodes`: (node, dim, vector binary of float64, members: the smallest ids of it). `edges`: (node, neighbours)."""

    nodes: DataFrame
    edges: DataFrame


def closest(df: DataFrame, key: str, order: list[Column], count: int) -> DataFrame:
    """The first `count` rows of each key. Spark cuts each task's rows of a key to `count` before it shuffles them, so
    a key of very many rows is no large group."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= count).drop("place")


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row_id, v in zip(batch["id"], batch["v"], strict=True):
            if v is None or len(v) == 0 or any(x is None for x in v):
                continue
            a = np.asarray(v, np.float64) + 0.0  # one zero only
            top = float(np.abs(a).max())
            if 0 < top < math.inf:
                out.append((row_id, hashlib.blake2b(a.tobytes(), digest_size=16).digest(), len(a), a.tobytes(), top))
        yield pd.DataFrame(out, columns=["id", "key", "dim", "vector", "top"])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two float64 matrices; scaled where squares would leave the range."""
    b = np.broadcast_to(b, a.shape)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = a - b
        out = np.sqrt((gap * gap).sum(axis=1))
        odd = ~np.isfinite(out) | ((out < 1e-150) & (a != b).any(axis=1))
        if odd.any():
            half = a[odd] / 2 - b[odd] / 2
            top = np.abs(half).max(axis=1, keepdims=True)
            out[odd] = np.sqrt(((half / top) ** 2).sum(axis=1)) * top[:, 0] * 2
    return out


@F.pandas_udf(DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out, width = np.full(len(a), np.nan), a.map(len).to_numpy()
    for w in np.unique(width):
        of = np.flatnonzero((width == w) & (b.map(len).to_numpy() == w))
        x = np.frombuffer(b"".join(a.iloc[of]), np.float64).reshape(len(of), -1)
        y = np.frombuffer(b"".join(b.iloc[of]), np.float64).reshape(len(of), -1)
        out[of] = distances(x, y)
    return pd.Series(out)


def _closest_of(x: np.ndarray, allowed: np.ndarray | None, bound: np.ndarray | None, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to `count` of the closest other rows of each row: (row, other, squared distance)."""
    x = x.astype(np.float32)
    x = x - x.mean(axis=0)
    square = (x * x).sum(axis=1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    if allowed is not None:
        d[~allowed] = np.inf
    if bound is not None:
        d[d >= bound[:, None]] = np.inf
    if count < len(x):
        other = np.argpartition(d, count, axis=1)[:, :count]
    else:
        other = np.tile(np.arange(len(x)), (len(x), 1))
    row = np.repeat(np.arange(len(x)), other.shape[1])
    other = other.ravel()
    found = d[row, other]
    ok = np.isfinite(found)
    return row[ok], other[ok], found[ok]


def _paths(order: int):
    """Adds each row's place in a random order, as bytes that sort: sides of hyperplanes, or a hash for the last order."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if order == ORDERS - 1:
                    path = [hashlib.blake2b(int(i).to_bytes(8, "little"), digest_size=8).digest() for i in part["node"]]
                else:
                    x = np.frombuffer(b"".join(part["x"]), np.float16).reshape(len(part), dim).astype(np.float64)
                    width = 1 << max(5, int(dim - 1).bit_length())
                    padded = np.zeros((len(x), width))
                    padded[:, :dim] = x
                    path = [p.tobytes() for p in np.packbits(rotated(padded, 77 + order)[:, :32] > 0, axis=1)]
                yield part.assign(path=path)

    return add


def _in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates within each run of BLOCK rows; the last run of a partition takes what would be a short one along."""
    held: pd.DataFrame | None = None

    def found(rows: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        out, start = [], 0
        while len(rows) - start >= (2 if last else 2 * BLOCK):
            left = len(rows) - start
            end = start + (left if left < 2 * BLOCK else BLOCK)
            part = rows.iloc[start:end]
            for dim, same in part.groupby("dim"):
                x = np.frombuffer(b"".join(same["x"]), np.float16).reshape(len(same), dim)
                row, other, d = _closest_of(x, None, None, FOUND_A_BLOCK)
                node = same["node"].to_numpy()
                out.append(pd.DataFrame({"node": node[row], "neighbour": node[other], "d": d}))
            start = end
        return out, rows.iloc[start:]

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        out, held = found(rows, False)
        yield from out
    if held is not None:
        yield from found(held, True)[0]


def _around(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """Candidates among the rows that meet at each node, where one of the two is new there and the distance would improve."""
    node, new, worst, x = rows["node"].to_numpy(), rows["new"].to_numpy(), rows["worst"].to_numpy(), rows["x"].to_numpy()
    found = [(node[:0], node[:0], np.zeros(0, np.float32))]
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        fresh = new[start:end]
        if end - start < 2 or not fresh.any():
            continue
        vectors = np.frombuffer(b"".join(x[start:end]), np.float16).reshape(end - start, -1)
        row, other, d = _closest_of(vectors, fresh[:, None] | fresh[None, :], worst[start:end], FOUND_A_BLOCK)
        found.append((node[start + row], node[start + other], d))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pd.DataFrame(dict(zip(("node", "neighbour", "d"), columns, strict=True)))


def _kept(candidates: DataFrame) -> DataFrame:
    """The KEPT closest of each node; a pair that was known before stays known."""
    once = candidates.groupBy("node", "neighbour").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return closest(once, "node", [F.asc("d"), F.asc("neighbour")], KEPT)


def _meeting(graph: DataFrame) -> DataFrame:
    """(at, node, new): every node with its own neighbours and its closest referrers."""
    own = graph.select(F.col("node").alias("at"), F.col("neighbour").alias("node"), "new", "d")
    referrers = closest(
        graph.select(F.col("neighbour").alias("at"), "node", "new", "d"), "at", [F.desc("new"), F.asc("d"), F.asc("node")], REVERSE
    )
    return own.unionByName(referrers).groupBy("at", "node").agg(F.max("new").alias("new"), F.min("d").alias("d"))


def _single(rows: DataFrame) -> DataFrame:
    """(id, key, dim, vector, top): one usable vector an id."""
    checked = rows.filter("id IS NOT NULL").mapInPandas(_checked, "id bigint, key binary, dim int, vector binary, top double")
    return checked.groupBy("id").agg(F.min_by(F.struct("key", "dim", "vector", "top"), "key").alias("r")).select("id", "r.*")


def build(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", members: int = 11) -> Graph:
    """The neighbour graph of all rows of `df`.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, take no part. An id
    with several vectors counts with one of them. Vectors of different widths never meet. Equal vectors are one node, which
    names its `members` smallest ids. An empty table gives an empty graph.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    single = materialize(_single(rows), "ann-rows")
    least = closest(single.select("key", "id"), "key", [F.asc("id")], members)
    named = least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("members"))
    # Vectors of a key are equal, so any one stands for it.
    classes = single.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    nodes = materialize(
        classes.join(named, "key").select(F.monotonically_increasing_id().alias("node"), "dim", "vector", "members"), "ann-nodes"
    )
    top = single.agg(F.max("top")).first()[0] or 1.0
    scale = 2.0 ** -min(1000, max(-1000, math.ceil(math.log2(top))))

    @F.pandas_udf("binary")
    def halved(vector: pd.Series) -> pd.Series:
        return vector.map(lambda b: (np.frombuffer(b, np.float64) * scale).astype(np.float16).tobytes())

    points = materialize(nodes.select("node", "dim", halved("vector").alias("x")), "ann-points")
    candidates = None
    for order in range(ORDERS):
        path = points.mapInPandas(_paths(order), "node bigint, dim int, x binary, path binary")
        ranged = path.repartitionByRange("dim", "path", "node").sortWithinPartitions("dim", "path", "node")
        found = ranged.mapInPandas(_in_blocks, "node bigint, neighbour bigint, d float")
        candidates = found if candidates is None else candidates.unionByName(found)
    graph = materialize(_kept(candidates.withColumn("new", F.lit(True))), "ann-graph")
    for _ in range(ROUNDS):
        total, fresh = graph.agg(F.count("*"), F.count_if("new")).first()
        if fresh <= SETTLED * total:
            break
        graph = materialize(_improved(graph, points), "ann-graph")
    meeting = _meeting(graph.withColumn("new", F.lit(False)))
    edges = meeting.groupBy(F.col("at").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("neighbours"))
    return Graph(nodes, materialize(edges, "ann-edges"))


def _improved(graph: DataFrame, points: DataFrame) -> DataFrame:
    """One round of the descent."""
    meeting = _meeting(graph)
    # Only where something new has come do candidates follow.
    busy = meeting.filter("new").select("at").distinct()
    bound = graph.groupBy("node").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    worst = F.when(F.col("n") >= KEPT, F.col("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst")
    measured = points.join(bound, "node").select("node", "x", worst)
    gathered = meeting.select("at", "node", "new").join(busy, "at", "left_semi").join(measured, "node")
    found = map_groups(gathered.select("at", "node", "new", "worst", "x"), ["at"], _around, "node bigint, neighbour bigint, d float")
    return _kept(graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))))


def _started(queries: DataFrame, graph: Graph) -> DataFrame:
    """(query, node): the pivots closest to each query. `queries`: (query, vector)."""
    chosen = graph.nodes.orderBy(F.xxhash64("node"), "node").limit(PIVOTS).select("node", "vector").collect()
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r["vector"]) for r in chosen}:
        same = [r for r in chosen if len(r["vector"]) == width]
        by_width[width] = (
            np.array([r["node"] for r in same], np.int64),
            np.frombuffer(b"".join(r["vector"] for r in same), np.float64).reshape(len(same), -1),
        )

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query, vector in zip(batch["query"], batch["vector"], strict=True):
                if len(vector) in by_width:
                    node, x = by_width[len(vector)]
                    d = distances(x, np.frombuffer(vector, np.float64)[None, :])
                    near = np.argsort(d, kind="stable")[:4]
                    yield pd.DataFrame({"query": query, "node": node[near]})

    return queries.mapInPandas(start, "query bigint, node bigint")


def _measured(pairs: DataFrame, queries: DataFrame, graph: Graph) -> DataFrame:
    """(query, node) with the distance in double precision."""
    vectors = graph.nodes.select("node", F.col("vector").alias("there"))
    both = pairs.join(vectors, "node").join(queries, "query")
    return both.select("query", "node", _distance("vector", "there").alias("d"))


def search(graph: Graph, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` closest members found for each query, without the query's own id.

    `queries` holds (query bigint, vector binary of float64, node: the query's own node or null), one row per query. Ties go to the
    smaller id; a query with fewer candidates gets them all.
    """
    queries = materialize(queries, "ann-queries")
    vectors = queries.select("query", "vector")
    first = _started(vectors, graph).unionByName(queries.filter("node IS NOT NULL").select("query", "node")).distinct()
    nearest = W.partitionBy("query").orderBy("d", "node")
    beam = materialize(_measured(first, vectors, graph).withColumn("followed", F.lit(False)), "ann-beam")
    while beam.filter("NOT followed").limit(1).count():
        # One row a query and place in the beam, so these windows are small.
        open_place = F.row_number().over(W.partitionBy("query", "followed").orderBy("d", "node"))
        marked = beam.withColumn("chosen", ~F.col("followed") & (open_place <= FOLLOWED))
        onward = (
            marked.filter("chosen")
            .join(graph.edges, "node")
            .select("query", F.explode("neighbours").alias("node"))
            .distinct()
            .join(beam.select("query", "node"), ["query", "node"], "left_anti")
        )
        seen = marked.select("query", "node", "d", (F.col("followed") | F.col("chosen")).alias("followed"))
        new = _measured(onward, vectors, graph).withColumn("followed", F.lit(False))
        ranked = seen.unionByName(new).withColumn("place", F.row_number().over(nearest))
        beam = materialize(ranked.filter(F.col("place") <= BEAM).drop("place"), "ann-beam")
    reached = beam.join(graph.nodes.select("node", "members"), "node").select("query", "d", F.explode("members").alias("id"))
    order = W.partitionBy("query").orderBy("d", "id")
    return (
        reached.filter("id <> query")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))
    )


def neighbours(df: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """`search` with the rows of `df` for which `queries` holds, against the graph of all its rows.

    Other columns are ignored; rows that take no part (see `build`) are neither queries nor results.
    """
    with finished_shuffles_dropped(df.sparkSession):
        graph = build(df, id_column, vector_column, k + 1)
        asked = df.filter(queries).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
        own = _single(asked).select(F.col("id").alias("query"), "vector").join(graph.nodes.select("node", "vector"), "vector")
        return search(graph, own.select("query", "vector", "node"), k)
