"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its inner s-mers stands at its first or last place.
That depends on the k-mer alone and on nothing around it, so an edit moves no anchor outside of it, and any
K - S + 1 consecutive k-mers hold one. All anchors are returned with their places, and likeness matches all of them in
order. The fingerprint is a compact sketch beside them: the SKETCH smallest hashes (first place of each), in text order.

Pairing a document with the next one in an order needs no window over all rows: ids are cut into ranges
at quantiles, one shuffle brings a range together, and the first row of each range is sent along to the
range before it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.wordhash import mix

K, S = 16, 6
SKETCH = 64
RANGE_ROWS = 5000
MOST_RANGES = 2000  # beyond that, ranges grow; they are streamed, so only their number costs memory

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` code points."""
    n = len(codes) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _FACTOR + codes[i : i + n]
    return mix(total)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers; a text without one is a single anchor as a whole."""
    codes = code_points(text).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(codes) >= K:
        inner = _rolled(codes, S)
        last = K - S
        least = _window_least(inner, last + 1)
        n = len(least)
        at = np.flatnonzero((inner[:n] == least) | (inner[last:] == least))
        if len(at):
            return at, _at(codes, at)
    whole = np.uint64(int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little"))
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


def _at(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers at the chosen places only."""
    total = np.full(len(at), K, np.uint64)
    for i in range(K):
        total = total * _FACTOR + codes[at + i]
    return mix(total)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """Up to SKETCH hashes, the smallest ones, in the order in which they first stand."""
    first = np.unique(hashes, return_index=True)[1]
    return hashes[np.sort(first[:SKETCH])]


def sketch(text: str) -> np.ndarray:
    """The smallest hashes of a text's anchors."""
    return smallest(anchors(text)[1])


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def _equal_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell the first, second, ... occurrence of a value apart."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(hashes))
    out = np.empty_like(hashes)
    out[order] = mix(ordered + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _FACTOR)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of all anchors of both texts together (a matched pair counts once) that match in the same order.

    An equal start and end match as they stand; between them the nth occurrence of a hash can match the nth. Equal
    sequences are 1, also two empty ones; an empty and another one are 0.
    """
    total = len(a) + len(b)
    head = _equal_start(a, b)
    a, b = a[head:], b[head:]
    tail = _equal_start(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    _, at_a, at_b = np.intersect1d(_numbered(a), _numbered(b), assume_unique=True, return_indices=True)
    chain: list[int] = []  # longest increasing run of places: moved anchors don't count
    for p in at_b[np.argsort(at_a)].tolist():
        if not chain or p > chain[-1]:
            chain.append(p)
        else:
            chain[bisect_left(chain, p)] = p
    shared = head + tail + len(at_a)
    return (head + tail + len(chain)) / (total - shared) if total else 1.0


def edited(text: str, following: str) -> str:
    """The last third of `text` replaced by as many first code points of the next text, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bounds(ids: DataFrame) -> list:
    """Ids that cut the table into ranges of about RANGE_ROWS rows; their number is what is collected."""
    rows = ids.count()
    parts = min(max(1, rows // RANGE_ROWS), MOST_RANGES)
    if parts == 1:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = ids.select(F.percentile_approx("id", cuts, 20 * parts).alias("q")).first()["q"]
    return sorted(set(found or []))


def with_next(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(range, tail, id, text): rows by range, and in each range as its tail the row that follows it.

    Rows stand by descending id, null ids last; rows that share an id by text, descending, nulls last.
    """
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    bounds = _bounds(rows.select("id").filter("id IS NOT NULL"))
    cuts = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds]).cast("array<bigint>")
    # Ranges count upwards in the order of the rows; null ids come behind all others.
    number = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(
        F.lit(len(bounds)) - F.size(F.filter(cuts, lambda b: b <= F.col("id")))
    )
    ranged = rows.withColumn("range", number)
    heads = {r["range"]: r["id"] for r in ranged.groupBy("range").agg(F.max("id").alias("id")).collect()}
    order = sorted(heads)
    before = {heads_range: order[i - 1] for i, heads_range in enumerate(order)}  # the last's next is the first
    if not order:
        return ranged.withColumn("tail", F.lit(0))
    previous = F.create_map(*[F.lit(x) for k in order for x in (k, before[k])])
    top = F.create_map(*[F.lit(x).cast("bigint") for k in order for x in (k, heads[k])])
    leads = F.col("id").eqNullSafe(F.element_at(top, F.col("range").cast("bigint")))
    one = lambda r, tail: F.struct(r.cast("int").alias("range"), F.lit(tail).alias("tail"))
    own = one(F.col("range"), 0)
    both = F.array(own, one(F.element_at(previous, F.col("range")), 1))
    places = F.explode(F.when(leads, both).otherwise(F.array(own)))
    return ranged.withColumn("at", places).select("at.range", "at.tail", "id", "text")


class _Print:
    """A text's anchors, computed once."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.places, self.hashes = anchors(self.text)
        self.print = as_text(smallest(self.hashes))


def _compared(row_id, own: _Print, following: _Print) -> tuple:
    changed = edited(own.text, following.text)
    other = _Print(changed)
    return (
        row_id,
        len(own.text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own.print,
        other.print,
        likeness(own.hashes, other.hashes),
        likeness(own.hashes, following.hashes),
        own.places.astype(np.int32),
        own.hashes.view(np.int64),
        other.places.astype(np.int32),
        other.hashes.view(np.int64),
    )


COLUMNS = [
    "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    "places", "hashes", "edited_places", "edited_hashes",
]
OUT_ANCHORS = 500_000  # about as many leave a worker at a time


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares each row with the next of its range; a range ends at its first tail row."""
    held: tuple | None = None  # (range, id, its print)
    closed = False
    for batch in batches:
        out, held_anchors = [], 0
        for number, tail, row_id, text in zip(batch["range"], batch["tail"], batch["id"], batch["text"], strict=True):
            if held is not None and held[0] == number and closed:
                continue  # another row with the id of the next range's first row
            row_id = None if pd.isna(row_id) else int(row_id)
            this = _Print(text if isinstance(text, str) else None)
            if held is not None and held[0] == number:
                out.append(_compared(held[1], held[2], this))
                held_anchors += len(out[-1][-1]) + len(out[-1][-3])
                if held_anchors >= OUT_ANCHORS:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out, held_anchors = [], 0
            held, closed = (number, row_id, this), bool(tail)
        yield pd.DataFrame(out, columns=COLUMNS)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `df`: its anchors and those of its edited text (places in code points, hashes in text order),
    fingerprints of both, and how its anchors liken those of its edited text and of the next text.

    Null texts are empty. An empty text has an empty fingerprint; a single row is its own next. Repeated rows
    follow each other. Other columns are ignored; an empty table gives an empty one.
    """
    order = [F.col("range"), F.col("tail"), F.col("id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    return (
        with_next(df, id_column, text_column)
        .repartition("range")
        .sortWithinPartitions(*order)
        .mapInPandas(
            _walk,
            "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, places array<int>, hashes array<bigint>, "
            "edited_places array<int>, edited_hashes array<bigint>",
        )
        .withColumnRenamed("id", id_column)
    )
