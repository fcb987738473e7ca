"""A quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a weighted sum of text features; one document is preferred to another with the logistic of
the difference. Weights minimise the logistic loss over pairs of a preferred (label 1) and another (label 0) labelled
document. The threshold is the quantile of the training worths that leaves as large a share below as label 0 has,
and scores are scaled so that it lies at THRESHOLD.

Training takes all labelled rows. Each row of the rarer label meets PARTNERS rows of the other, at places that its number
names. Features, pairs and worths stay in Spark; what a Newton step collects are sums of a fixed size per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.operators.ordered import numbered
from corpus_spark.session import materialize

FEW = 10_000  # values that the driver may sort
BINS = 1_024
PARTNERS = 20
PENALTY = 1e-3
THRESHOLD = 0.3
MEASURED = (
    T.StructField("hash", T.LongType()),
    T.StructField("x", T.ArrayType(T.DoubleType())),
)

_KIND = np.full(128, 4, np.int8)  # 0 space, 1 letter, 2 digit, 3 sentence mark, 4 other sign
for _c in range(128):
    if _c in (32, *range(9, 14)):
        _KIND[_c] = 0
    elif chr(_c).isalpha():
        _KIND[_c] = 1
    elif chr(_c).isdigit():
        _KIND[_c] = 2
    elif chr(_c) in ".,;:?'\"()-":
        _KIND[_c] = 3

NAMES = (
    "log_words", "word_length", "letters", "digits", "marks", "signs", "capitals", "distinct_words", "repeated_neighbours",
    "lone_signs", "signed_ends", "distinct_lines", "line_words", "stops", "one_letter", "long_words", "top_word",
    "distinct_squared", "signs_root", "capitals_squared", "neighbours_root",
)


def features(text: str | None) -> np.ndarray:
    """Numbers about the whole text; an empty one has zeros throughout."""
    out = np.zeros(len(NAMES))
    words = (text or "").split()
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = codes < 128
    kinds = np.bincount(np.where(ascii_, _KIND[np.where(ascii_, codes, 0)], 1), minlength=5)
    seen = max(1, int(kinds[1:].sum()))
    letters = max(1, int(kinds[1]))
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper()) / len(words)
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.array(list(map(len, words)))
    neighbours = sum(map(str.__eq__, words[1:], words[:-1])) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = "".join([w[-1] for w in words])
    stops = ends.count(".") / n
    signed = sum(ends.count(c) for c in "!%&$#*|~^@=<>") / n
    lone = sum(c for w, c in counts.items() if not any(map(str.isalnum, w[:3]))) / n
    distinct = len(counts) / n
    expected = min(1.0, 2.0 * n**-0.25)  # longer texts repeat more words anyway
    signs = kinds[4] / seen
    out[:] = (
        np.log1p(n), lengths.mean(), letters / seen, kinds[2] / seen, kinds[3] / seen, signs, capitals,
        distinct / expected, neighbours, lone, signed, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        stops, (lengths == 1).mean(), (lengths > 20).mean(), max(counts.values()) / n,
        (distinct / expected) ** 2, np.sqrt(signs), capitals**2, np.sqrt(neighbours),
    )
    return out


@dataclass
class Ranking:
    """`worth` of a text is weights . (features - centre) / spread."""

    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    threshold: float
    steepness: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the threshold, higher where label 1 is likelier."""
        z = self.steepness * (self.worth(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(rows: DataFrame, columns: list[str], sums) -> np.ndarray:
    """`sums(*matrices)`, a fixed number of numbers per batch of the array columns, added up: one row a task comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                found = sums(*[np.stack(batch[c].to_numpy()) for c in columns])
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    parts = rows.select(*columns).mapInPandas(run, "s array<double>").toPandas()["s"]
    return np.stack(parts.to_numpy()).sum(axis=0)


def _pairs(rows: DataFrame, ranking: Ranking, n_good: int, n_bad: int) -> DataFrame:
    """(d): features of a preferred row less those of the other, standardised; PARTNERS of them for each row of the rarer label."""
    rare, n_other = (0, n_good) if n_bad <= n_good else (1, n_bad)
    placed = numbered(rows, ["label"], ["hash", "id"], "place").withColumn("place", F.col("place") - 1)
    nth = F.col("place") * PARTNERS + F.col("partner")
    few = placed.filter(F.col("label") == rare).withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(PARTNERS - 1))))
    few = few.select(F.col("x").alias("few"), ((nth % n_other) * (2654435761 % n_other) % n_other).alias("place"))
    many = placed.filter(F.col("label") != rare).select("place", F.col("x").alias("many"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                few, many = (ranking.standard(np.stack(batch[c].to_numpy())) for c in ("few", "many"))
                yield pd.DataFrame({"d": list(many - few if rare == 0 else few - many)})

    return few.join(many, "place").select("few", "many").mapInPandas(run, "d array<double>")


def _nth(values: DataFrame, n: int) -> float:
    """The value at place `n`, from 0, of the double column `worth` in order: counts per bin narrow it down until few are left."""
    low, high, count = values.agg(F.min("worth"), F.max("worth"), F.count("worth")).first()
    while low < high and count > FEW:
        place = F.floor((F.col("worth") - low) / F.lit((high - low) / BINS))
        inside = values.filter(F.col("worth").between(low, high)).groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"))
        for r in sorted(inside.agg(F.min("worth").alias("low"), F.max("worth").alias("high"), F.count("*").alias("n")).collect()):
            if n < r["n"]:
                low, high, count = r["low"], r["high"], r["n"]
                break
            n -= r["n"]
    if low == high:
        return low
    return sorted(r[0] for r in values.filter(F.col("worth").between(low, high)).collect())[n]


def fit(rows: DataFrame) -> Ranking:
    """A ranking from `rows` (id, hash, label, x), all of them, by Newton steps on the pairwise loss; without both labels every text
    scores alike. The same rows give the same ranking up to the rounding of sums."""
    counts = dict(rows.groupBy("label").count().collect())
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    n, size = n_good + n_bad, len(NAMES)
    ranking = Ranking(np.zeros(size), np.zeros(size), np.ones(size), 0.0, 1.0)
    if not n_good or not n_bad:
        ranking.threshold = 1.0 if n_bad else -1.0
        return ranking
    centre = _sums(rows, ["x"], lambda x: x.sum(axis=0)) / n
    spread = np.sqrt(_sums(rows, ["x"], lambda x: ((x - centre) ** 2).sum(axis=0)) / n)
    spread[spread < 1e-12] = 1
    ranking.centre, ranking.spread = centre, spread
    pairs, n_pairs = materialize(_pairs(rows, ranking, n_good, n_bad), "quality-pairs"), min(n_good, n_bad) * PARTNERS
    w = np.zeros(size)
    for _ in range(25):

        def sums(d: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the pair the wrong way round
            return np.concatenate([p @ d, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        found = _sums(pairs, ["d"], sums) / n_pairs
        slope = -found[:size] + PENALTY * w
        step = np.linalg.solve(found[size:].reshape(size, size) + PENALTY * np.eye(size), slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    ranking.weights = w

    def worths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"worth": ranking.worth(np.stack(batch["x"].to_numpy()))})

    worth = materialize(rows.select("x").mapInPandas(worths, "worth double"), "quality-worths")
    # The quantile of label 0's share, in the middle between its neighbours.
    ranking.threshold = (_nth(worth, n_bad - 1) + _nth(worth, min(n_bad, n - 1))) / 2
    return ranking


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Ranking:
    """A ranking from `docs` (id, text) and `labels` (id, label).

    Rows without a label of 0 or 1 are passed over, rows that repeat id and text count once, a null text is empty and
    an id with two labels has the higher. Texts never move: features are taken where the texts are, of every row, and meet the
    labels by id.
    """
    texts = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text", "id"))
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    marks = marks.filter("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hash": batch["hash"], "x": [features(t) for t in batch["text"]]})

    measured = texts.mapInPandas(run, T.StructType([texts.schema["id"], *MEASURED]))
    return fit(materialize(measured.join(marks, "id").dropDuplicates(["id", "hash"]), "quality-labelled"))


def score(df: DataFrame, ranking: Ranking, text_column: str = "text") -> DataFrame:
    """`df` with quality_score (0 to 1) and quality_predicted (1 from THRESHOLD).

    Null and empty texts have features of zero and a score like any other; equal texts score alike; other columns
    pass through; an empty table gives an empty one.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if len(texts):
                yield pd.Series(ranking.score(np.stack([features(t) for t in texts])))
            else:
                yield pd.Series([], dtype="float64")

    return df.withColumn("quality_score", scored(F.col(text_column).cast("string"))).withColumn(
        "quality_predicted", (F.col("quality_score") >= THRESHOLD).cast("int")
    )
