"""MinHash near-duplicates by a signature-coordinate inverted join.

Every set of word shingles gets `COORDINATES` minimum hashes. A set is posted under its coordinate-value
pairs, rarest first: two sets that agree in at least `matches` coordinates must meet in the first
`COORDINATES - matches + 1` of them (the prefix), so the long lists at the end are skipped and only looked up
when collisions are counted. A pair with similarity 0.85 agrees in fewer than 17 of 32 coordinates with a
chance of 3.5 in a million, one with 0.80 in fewer than 14 with 1.2 in a million. Pairs over the match threshold
are confirmed on their full sets.

No list is paired with itself row by row. First every set is compared with one hub, the most central set of
its lists, which links a group of near copies in linear work. What the hubs leave apart in a list is then
compared in blocks: collisions are counted in numpy, and only a spanning forest of the candidates leaves a
block. Full sets meet once per candidate cluster, again in blocks. A hot list or cluster is many blocks.

Equal sets are one class from the start, so exact copies cost nothing but their signature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.blocks import forest, in_block_pairs, map_groups
from corpus_spark.llm.components import components
from corpus_spark.llm.wordhash import Words, chunks, shingle_set
from corpus_spark.session import materialize

SHINGLE_WORDS = 5
PERCENT = 85
COORDINATES = 32
MATCHES = 17
LIST_BLOCK = 1024
SET_BLOCK = 128
MATRIX_COLUMNS = 4096

_random = np.random.Generator(np.random.PCG64(7))
_FACTORS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, as 32-bit integers."""
    least = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = (shingles[start : start + 4096, None] * _FACTORS[None, :]) >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0))
    return least.astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(texts) -> Iterator[np.ndarray]:
    values = [t if isinstance(t, str) else None for t in texts]
    for a, b in chunks(values):
        words = Words(values[a:b])
        for i in range(b - a):
            yield shingle_set(words.of(i), SHINGLE_WORDS)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes, keys, signatures = [], [], []
        for s in _sets(batch["text"]):
            sizes.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            signatures.append(signature(s) if len(s) else None)
        yield pd.DataFrame({"id": batch["id"], "n": sizes, "key": keys, "sig": signatures})


def _with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = list(_sets(batch["text"]))
        yield pd.DataFrame(
            {
                "key": batch["key"],
                "right": [set_key(s) == k for s, k in zip(sets, batch["key"], strict=True)],
                "shingles": [s.view(np.int64) for s in sets],
            }
        )


def _fits(percent: int, small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Whether sizes alone leave the similarity possible."""
    low, high = np.minimum(small, large), np.maximum(small, large)
    return 100 * low >= percent * high


def _forest_frame(keys: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    nodes, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left, right in pairs:
        node, root = forest(left, right)
        nodes.append(node)
        roots.append(root)
    out = pd.DataFrame({"a": keys[np.concatenate(nodes)], "b": keys[np.concatenate(roots)]})
    return out[out["a"] != out["b"]]


def _sides(side: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    part = side[start:end]
    return start + np.flatnonzero(part != 1), start + np.flatnonzero(part != 0)


def _block_candidates(percent: int, matches: int, rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """Pairs within pairs of blocks whose signatures agree often enough, as spanning forests."""
    sig, n, side = np.stack(rows["sig"].to_numpy()), rows["n"].to_numpy(), rows["side"].to_numpy()
    star = pd.factorize(rows["star"])[0]
    pairs = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        first, second = _sides(side, start, end)
        if end - start < 2 or not len(first) or not len(second):
            continue
        left, right = [], []
        for i in range(0, len(first), 64):
            top = first[i : i + 64]
            agree = np.zeros((len(top), len(second)), np.uint8)
            for c in range(sig.shape[1]):
                agree += sig[top, c, None] == sig[None, second, c]
            good = (agree >= matches) & (star[top, None] != star[None, second])
            x, y = np.nonzero(good & _fits(percent, n[top, None], n[None, second]))
            left.append(top[x])
            right.append(second[y])
        pairs.append((np.concatenate(left), np.concatenate(right)))
    return _forest_frame(rows["key"].to_numpy(), pairs)


def intersections(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted distinct arrays."""
    a, b = np.concatenate(first), np.concatenate(second)
    rows_a = np.repeat(np.arange(len(first)), [len(x) for x in first])
    rows_b = np.repeat(np.arange(len(second)), [len(x) for x in second])
    shared = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    for rows, at, values in ((rows_a, at_a, a), (rows_b, at_b, b)):
        at[at == len(shared)] = 0
        at[(shared[at] if len(shared) else values + 1) != values] = -1
    found = np.zeros((len(first), len(second)))
    width = min(MATRIX_COLUMNS, max(1, len(shared)))
    by_a, by_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    for start in range(0, len(shared), width):
        sides = []
        for rows, at, by, n in ((rows_a, at_a, by_a, len(first)), (rows_b, at_b, by_b, len(second))):
            low, high = np.searchsorted(at, [start, start + width], sorter=by)
            one = np.zeros((n, width), np.float32)
            one[rows[by[low:high]], at[by[low:high]] - start] = 1
            sides.append(one)
        found += sides[0] @ sides[1].T
    return np.rint(found).astype(np.int64)


def _block_links(percent: int, rows: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """Confirmed links within pairs of blocks, as spanning forests."""
    sets = [np.asarray(s, np.int64) for s in rows["shingles"]]
    size = np.array([len(s) for s in sets])
    side, pairs = rows["side"].to_numpy(), []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        first, second = _sides(side, start, end)
        if end - start < 2 or not len(first) or not len(second):
            continue
        common = intersections([sets[i] for i in first], [sets[i] for i in second])
        union = size[first][:, None] + size[second][None, :] - common
        left, right = np.nonzero(100 * common >= percent * union)
        pairs.append((first[left], second[right]))
    return _forest_frame(rows["key"].to_numpy(), pairs)


def _agreements(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n, key, sig) of every row of `docs` (id, text), written."""
    return materialize(
        docs.mapInPandas(_signed, "id bigint, n bigint, key binary, sig array<int>"), "minhash-signatures"
    )


def prefix_posts(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(coord, value, key, weight): the prefix of each class among lists of two or more; weight: how
    many sets share its values, over all coordinates, which is high in the middle of a group."""
    posts = classes.select("key", F.posexplode("sig").alias("coord", "value"))
    lists = posts.groupBy("coord", "value").agg(F.count("*").alias("held")).filter("held > 1")
    ranked = F.array_sort(F.collect_list(F.struct("held", "coord", "value")))  # at most COORDINATES
    chosen = (
        posts.join(lists, ["coord", "value"])
        .groupBy("key")
        .agg(ranked.alias("ranked"), F.sum("held").alias("weight"))
        # Values that no other set has come first in the order of rarity and post nothing.
        .withColumn("room", F.size("ranked") - F.lit(matches - 1))
        .filter("room > 0")
    )
    return chosen.select("key", "weight", F.explode(F.slice("ranked", F.lit(1), F.col("room"))).alias("p")).select(
        "p.coord", "p.value", "key", "weight"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("common", common)
        .filter(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * percent)
        .select("a", "b")
    )


def links(docs: DataFrame, signed: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """(a, b): links between classes that join the same classes as all links would."""
    classes = materialize(
        signed.filter("n > 0")
        .groupBy("key")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")),
        "minhash-classes",
    )
    posts = materialize(prefix_posts(classes, matches), "minhash-posts")
    candidates = posts.select("key").distinct()
    wanted = classes.join(candidates, "key", "left_semi").select(F.col("rep").alias("id"), "key")
    sets = materialize(
        docs.join(wanted.withColumnRenamed("id", "rep"), F.col("id").eqNullSafe(F.col("rep")))
        .select("key", "text")
        .mapInPandas(_with_sets, "key binary, right boolean, shingles array<bigint>")
        .filter("right")
        .drop("right")
        .dropDuplicates(["key"]),
        "minhash-sets",
    )
    # One hub per set: the most central one of its lists.
    hubs = posts.groupBy("coord", "value").agg(F.max(F.struct("weight", "key")).alias("hub"))
    chosen = (
        posts.join(hubs, ["coord", "value"]).groupBy("key").agg(F.max("hub").alias("hub")).select("key", "hub.key")
    ).toDF("a", "b")
    sig = classes.select("key", "sig")
    close = (
        chosen.filter("a <> b")
        .join(sig.toDF("a", "sig_a"), "a")
        .join(sig.toDF("b", "sig_b"), "b")
        .filter(_agreements("sig_a", "sig_b") >= matches)
        .select("a", "b")
    )
    starred = materialize(_confirmed(close, sets, percent), "minhash-stars")
    # Lists in which the hubs have left sets apart.
    named = posts.join(starred.toDF("key", "hub"), "key", "left").select(
        "coord", "value", "key", F.coalesce("hub", "key").alias("star")
    )
    apart = (
        named.groupBy("coord", "value")
        .agg(F.min("star").alias("low"), F.max("star").alias("high"))
        .filter("low <> high")
        .select("coord", "value")
    )
    rest = named.join(apart, ["coord", "value"]).join(classes.select("key", "n", "sig"), "key")
    blocks = in_block_pairs(rest, ["coord", "value"], "key", LIST_BLOCK)
    compared = partial(_block_candidates, percent, matches)
    maybe = map_groups(blocks, ["coord", "value", "low", "high"], compared, "a binary, b binary")
    clusters = components(maybe, "minhash-clusters")
    members = sets.join(clusters.toDF("key", "cluster"), "key")
    checked = map_groups(
        in_block_pairs(members, ["cluster"], "key", SET_BLOCK),
        ["cluster", "low", "high"],
        partial(_block_links, percent),
        "a binary, b binary",
    )
    return starred.unionByName(checked)


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, matches: int = MATCHES
) -> DataFrame:
    """(id_column, n_shingles, component_id, kept) per row of `df`.

    Texts are linked at 100 * intersection >= percent * union of their sets of distinct five-word shingles; a
    text of fewer words is one shingle. Candidates agree in `matches` coordinates; a lower percent needs fewer. Null and wordless texts have no shingle, link with nothing and
    are their own component. `component_id` is the smallest id reachable (nulls are passed over; a
    wordless text's own id), `kept` is whether that is the row's id; rows that repeat an id keep together
    and a null id is kept only where no other id is there. Other columns are ignored; an empty table gives an
    empty one.
    """
    docs = df.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    signed = signatures(docs)
    roots = components(links(docs, signed, percent, matches), "minhash-components").toDF("key", "root")
    rooted = materialize(
        signed.select("id", "n", "key")
        .join(roots, "key", "left")
        .withColumn("root", F.coalesce("root", "key")),
        "minhash-rooted",
    )
    labels = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("label"))
    label = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("label"))
    return rooted.join(labels, "root", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        label.alias("component_id"),
        label.eqNullSafe(F.col("id")).alias("kept"),
    )
