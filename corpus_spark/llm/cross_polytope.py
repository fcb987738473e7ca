"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A hash is the signed axis closest to the rotated vector; a rotation is three rounds of random signs and a fast
Hadamard transform. `HASHES` hashes name a bucket of each of `TABLES` tables. A vector lies in its own bucket
and probes the ones in which one hash takes its second closest axis. Pairs that meet are verified by their
cosine in double precision; what is reported has a cosine of at least `COSINE`, always.

Equal vectors are one class. A bucket is compared in pairs of blocks with one matrix product each, and a block
returns counts and a spanning forest, never pairs. A pair counts in the first table in which it meets only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.blocks import forest, in_block_pairs, map_groups
from corpus_spark.llm.components import components
from corpus_spark.session import materialize

COSINE = 0.95
TABLES = 7
HASHES = 2
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, scaled to keep lengths; widths are powers of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (3, x.shape[1]))
    for row in signs:
        x = hadamard(x * row)
    return x


def _axes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest and the second closest signed axis of every row."""
    rows, size = np.arange(len(r)), np.abs(r)
    first = size.argmax(axis=1)
    size[rows, first] = -1
    second = size.argmax(axis=1)
    return 2 * first + (r[rows, first] < 0), 2 * second + (r[rows, second] < 0)


def buckets(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + HASHES): each row's own bucket in every table, then the ones that it probes."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), TABLES, 1 + HASHES), np.int64)
    for table in range(TABLES):
        axes = [_axes(rotated(padded, 1000 * table + h)) for h in range(HASHES)]
        for probe in range(1 + HASHES):
            code = np.zeros(len(x), np.int64)
            for h, (first, second) in enumerate(axes):
                code = code * 2 * width + (second if probe == h + 1 else first)
            out[:, table, probe] = code
    return out


def _vector(v) -> np.ndarray | None:
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64) + 0.0
    # Scaled by the largest component, so that neither tiny nor huge vectors lose their length.
    top = np.abs(a).max()
    return a if np.isfinite(top) and top > 0 else None


def _prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        vectors = [_vector(v) for v in batch["v"]]
        units = [None if a is None else (b := a / np.abs(a).max()) / np.sqrt(b @ b) for a in vectors]
        yield pd.DataFrame(
            {
                "id": batch["id"],
                "key": [None if a is None else hashlib.blake2b(a.tobytes(), digest_size=16).digest() for a in vectors],
                "dim": [0 if a is None else len(a) for a in vectors],
                "unit": [None if u is None else u.tobytes() for u in units],
            }
        )


def _posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), dim)
            codes = buckets(x)
            whole = [c.tobytes() for c in codes]
            for table in range(TABLES):
                for probe in range(1 + HASHES):
                    yield part.assign(
                        table=table, bucket=codes[:, table, probe], probe=np.int32(probe), codes=whole
                    )


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of codes (pairs, tables, probes) meet, by table."""
    own = a[:, :, 0] == b[:, :, 0]
    return own | (a[:, :, :1] == b[:, :, 1:]).any(axis=2) | (b[:, :, :1] == a[:, :, 1:]).any(axis=2)


def _block(rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """Links within pairs of blocks: (a, NULL, how many vectors a is linked with), (a, b, 0) for forests."""
    dim = rows["dim"].to_numpy()
    table, side = rows["table"].to_numpy(), rows["side"].to_numpy()
    own = rows["probe"].to_numpy() == 0
    codes = np.frombuffer(b"".join(rows["codes"]), np.int64).reshape(len(rows), TABLES, 1 + HASHES)
    keys, weight, units = rows["key"].to_numpy(), rows["weight"].to_numpy(), rows["unit"].to_numpy()
    linked = np.zeros(len(rows))
    nodes, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        part = side[start:end]
        first, second = start + np.flatnonzero(part != 1), start + np.flatnonzero(part != 0)
        if end - start < 2 or not len(first) or not len(second):
            continue
        x = np.frombuffer(b"".join(units[start:end]), np.float64).reshape(end - start, dim[start])
        near = (x[first - start] @ x[second - start].T >= COSINE) & (own[first][:, None] | own[second][None, :])
        i, j = np.nonzero(near)
        i, j = first[i], second[j]
        once = keys[i] < keys[j] if part[0] == 2 else keys[i] != keys[j]
        i, j = i[once], j[once]
        if not len(i):
            continue
        new = _first_meeting(codes[i], codes[j], own[i], own[j], keys[i] < keys[j], table[start])
        i, j = i[new], j[new]
        np.add.at(linked, i, weight[j])
        np.add.at(linked, j, weight[i])
        node, root = forest(i, j)
        nodes.append(node)
        roots.append(root)
    some = np.flatnonzero(linked)
    node, root = np.concatenate(nodes), np.concatenate(roots)
    return pd.DataFrame(
        {
            "a": np.concatenate([keys[some], keys[node]]),
            "b": np.concatenate([np.full(len(some), None, object), keys[root]]),
            "n": np.concatenate([linked[some], np.zeros(len(node))]).astype(np.int64),
        }
    )


def _first_meeting(
    a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, a_less: np.ndarray, table: int
) -> np.ndarray:
    """Whether this bucket of `table` is the one in which each pair of rows of codes counts."""
    probed = (a[:, table, :1] == b[:, table, 1:]).any(axis=1)  # b probes a's own bucket
    probing = (b[:, table, :1] == a[:, table, 1:]).any(axis=1)
    equal = a[:, table, 0] == b[:, table, 0]
    # Where each probes the other's bucket, the own bucket of the smaller key counts.
    chosen = np.where(a_less, own_a, own_b)
    here = np.where(equal, own_a & own_b, ~(probed & probing) | chosen)
    return here & ~_met(a[:, :table], b[:, :table]).any(axis=1)


def near_duplicates(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id_column, n_links, component_id, kept) per row of `df`.

    Null, empty and zero vectors, and those with a null or non-finite component, link with nothing and are
    their own component. Vectors of different widths don't link. `n_links` counts other ids, equal vectors
    included; `component_id` is the smallest id reachable (nulls are passed over), `kept` is whether that
    is the row's own. Repeated rows of one id count once. Other columns are ignored; an empty table gives an
    empty one.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    prepared = materialize(
        rows.mapInPandas(_prepared, "id bigint, key binary, dim int, unit binary"), "embedding-rows"
    )
    classes = (
        prepared.filter("key IS NOT NULL")
        .groupBy("key", "dim", "id")
        .agg(F.first("unit").alias("unit"))
        .groupBy("key", "dim")
        .agg(F.first("unit").alias("unit"), F.count("*").alias("weight"))
    )
    posted = materialize(
        classes.mapInPandas(
            _posted,
            "key binary, dim int, unit binary, weight bigint, table int, bucket bigint, probe int, codes binary",
        ),
        "embedding-posts",
    )
    group = ["dim", "table", "bucket"]
    found = materialize(
        map_groups(
            in_block_pairs(posted, group, "key", BLOCK),
            [*group, "low", "high"],
            _block,
            "a binary, b binary, n bigint",
        ),
        "embedding-links",
    )
    counts = found.groupBy("a").agg(F.sum("n").alias("outside"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"), "embedding-components")
    known = (
        classes.select("key", "weight")
        .join(counts.withColumnRenamed("a", "key"), "key", "left")
        .join(roots.toDF("key", "root"), "key", "left")
        .select("key", "weight", "outside", F.coalesce("root", "key").alias("root"))
    )
    rooted = materialize(prepared.select("id", "key").join(known, "key", "left"), "embedding-rooted")
    labels = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("label"))
    label = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("label"))
    links = F.coalesce("outside", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return rooted.join(labels, "root", "left").select(
        F.col("id").alias(id_column),
        links.cast("bigint").alias("n_links"),
        label.alias("component_id"),
        label.eqNullSafe(F.col("id")).alias("kept"),
    )
