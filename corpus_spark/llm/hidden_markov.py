"""A hidden Markov language model over words, for an open vocabulary.

A latent state emits a word's class (its first and last bytes and its length, hashed to CLASSES), and the class emits the
word by its smoothed share of the class, whatever the state. So states need a table of fixed size, while the
word counts, which grow with the corpus, never leave Spark: texts are written once as numbers of a dictionary per
chunk of the corpus, the dictionaries are counted and joined by word, and each chunk gets its own counts back.

Baum-Welch takes every training token in every round: partitions add up expected counts, Spark sums them, and the driver
holds one model. Training cuts sequences into segments of SEGMENT tokens with a start distribution of
their own; likelihoods are computed on whole sequences by the scaled forward recursion, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.wordhash import Words, chunks, mix
from corpus_spark.session import fresh_path, materialize

STATES = 8
CLASSES = 4096
END_CLASS = 0
END_HASH = np.uint64(0x5851F42D4C957F2D)
CHUNK_TOKENS = 3_000_000
SEGMENT = 256  # 2048 changes the held-out log10 per token on sf0.1 by 0.0001 (-3.9599 against -3.9600)
ROUNDS = 8  # at most; fewer when a round gains less than GAIN a token in log likelihood
GAIN = 1e-3
PRIOR = 50.0
GROUP = 1024


def word_classes(words: Words) -> np.ndarray:
    """A class in 1 .. CLASSES - 1 per word; words of up to six bytes share one only by chance."""
    length = words.ends - words.starts
    key = np.minimum(length, 7).astype(np.uint64)
    for i in range(3):
        inside = length > i
        first = np.where(inside, words.buffer[np.where(inside, words.starts + i, 0)], 0)
        last = np.where(inside, words.buffer[np.where(inside, words.ends - 1 - i, 0)], 0)
        key = (key << np.uint64(8) | first) << np.uint64(8) | last
    return (mix(key) % np.uint64(CLASSES - 1)).astype(np.int64) + 1


class _Chunk:
    """Texts on their way into one chunk."""

    def __init__(self) -> None:
        self.ids: list = []
        self.held: list[bool] = []
        self.hashes: list[np.ndarray] = []
        self.classes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, ids: list, held: list[bool], texts: list) -> None:
        words = Words(texts)
        n = np.diff(words.offsets)
        # Every text ends with the end token.
        at = np.repeat(np.arange(len(texts)), n) + np.arange(len(words.hashes))
        hashes = np.full(len(words.hashes) + len(texts), END_HASH, np.uint64)
        classes = np.full(len(hashes), END_CLASS, np.int64)
        hashes[at], classes[at] = words.hashes, word_classes(words)
        self.ids += ids
        self.held += held
        self.hashes.append(hashes)
        self.classes.append(classes)
        self.sizes.append(n + 1)
        self.tokens += len(hashes)

    def rows(self, number: int) -> pd.DataFrame:
        hashes, classes, sizes = (np.concatenate(x) for x in (self.hashes, self.classes, self.sizes))
        known, first, back, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")
        place = np.empty(len(known), np.int32)
        place[by_count] = np.arange(len(known), dtype=np.int32)
        tokens = place[back]
        learned = np.repeat(~np.array(self.held), sizes)
        seen = np.bincount(tokens[learned], minlength=len(known))
        ends = np.cumsum(sizes)
        narrow = classes.astype(np.uint16)
        n = len(self.ids)
        docs = pd.DataFrame(
            {
                "id": pd.array(self.ids, dtype="Int64"),
                "held": self.held,
                "tokens": [tokens[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)],
                "classes": [narrow[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)],
                "words": [None] * n,
                "seen": [None] * n,
                "word_classes": [None] * n,
            }
        )
        dictionary = pd.DataFrame(
            {
                "id": pd.array([None], dtype="Int64"),
                "held": [None],
                "tokens": [None],
                "classes": [None],
                "words": [known[by_count].view(np.int64)],
                "seen": [seen],
                "word_classes": [classes[first[by_count]]],
            }
        )
        out = pd.concat([docs, dictionary], ignore_index=True)
        out.insert(0, "chunk", number)
        return out


_CODED = (
    "chunk bigint, id bigint, held boolean, tokens binary, classes binary, "
    "words array<bigint>, seen array<bigint>, word_classes array<int>"
)


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = TaskContext.get().partitionId() << 32
    chunk = _Chunk()
    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        ids = [None if pd.isna(i) else int(i) for i in batch["id"]]
        held = batch["held"].tolist()
        for a, b in chunks(texts):
            chunk.add(ids[a:b], held[a:b], texts[a:b])
            if chunk.tokens >= CHUNK_TOKENS:
                yield chunk.rows(number)
                number, chunk = number + 1, _Chunk()
    if chunk.ids:
        yield chunk.rows(number)


@dataclass
class Model:
    start: np.ndarray  # (states)
    moves: np.ndarray  # (states, states)
    emits: np.ndarray  # (states, classes)


def first_model(shares: np.ndarray, states: int = STATES) -> Model:
    """States that prefer different classes at random and like to stay."""
    noise = np.random.Generator(np.random.PCG64(11)).gamma(0.5, 1.0, (states, len(shares)))
    emits = shares * (noise + 0.05)
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def _stacked(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, sequence) matrix, longest first, and how many sequences reach each time."""
    lengths = np.array(list(map(len, sequences)))
    out = np.zeros((int(lengths[0]), len(sequences)), np.int64)
    for i, s in enumerate(sequences):
        out[: len(s), i] = s
    return out, np.searchsorted(-lengths, -np.arange(len(out)), "left")


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of some sequences, and their log likelihood."""
    states, emits = len(model.start), model.emits.T.copy()
    starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, emits.shape[0]))
    total = 0.0
    order = sorted((s for s in sequences if len(s)), key=len, reverse=True)
    for low in range(0, len(order), GROUP):
        seen, live = _stacked(order[low : low + GROUP])
        steps, width = seen.shape
        ahead, scale = np.zeros((steps, width, states)), np.ones((steps, width))
        for t in range(steps):
            n = live[t]
            a = (model.start if t == 0 else ahead[t - 1, :n] @ model.moves) * emits[seen[t, :n]]
            scale[t, :n] = a.sum(axis=1)
            ahead[t, :n] = a / scale[t, :n, None]
        total += float(np.log(scale).sum())
        back = np.ones((width, states))
        for t in range(steps - 1, -1, -1):
            n = live[t]
            both = ahead[t, :n] * back[:n]
            if t:
                weighed = emits[seen[t, :n]] * back[:n] / scale[t, :n, None]
                moves += model.moves * (ahead[t - 1, :n].T @ weighed)
                back[:n] = weighed @ model.moves.T
            else:
                starts += both.sum(axis=0)
            ahead[t, :n] = both
        reached = np.arange(width)[None, :] < live[:, None]
        flat, chance = seen[reached], ahead[reached]
        for k in range(states):
            emitted[k] += np.bincount(flat, weights=chance[:, k], minlength=emits.shape[0])
    return starts, moves, emitted, total


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """The natural log of each sequence's probability, by the scaled forward recursion over the whole of it."""
    emits, out = model.emits.T.copy(), np.zeros(len(sequences))
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    for low in range(0, len(order), GROUP):
        part = order[low : low + GROUP]
        lengths = np.array([len(sequences[i]) for i in part])
        # Time by time over the sequences that are still going; only the current column is held.
        flat = np.concatenate([sequences[i] for i in part])
        begin = np.cumsum(lengths) - lengths
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        logs, state = np.zeros(len(part)), np.zeros((len(part), len(model.start)))
        for t in range(int(lengths[0])):
            n = live[t]
            a = (model.start if t == 0 else state[:n] @ model.moves) * emits[flat[begin[:n] + t]]
            scale = a.sum(axis=1)
            state = a / scale[:, None]
            logs[:n] += np.log(scale)
        out[part] = logs
    return out


def _sequences(blobs) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16).astype(np.int64) for b in blobs]


def _round(docs: DataFrame, model: Model, shares: np.ndarray) -> tuple[Model, float, float]:
    """One Baum-Welch round: counts per partition, summed by Spark, made into the next model. With it come the
    log likelihood under the model before, its prior included, and the number of tokens."""
    states = len(model.start)
    size = states + states * states + states * CLASSES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(size + 1)
        for batch in batches:
            cut = [s[i : i + SEGMENT] for s in _sequences(batch["classes"]) for i in range(0, len(s), SEGMENT)]
            starts, moves, emitted, total = expected_counts(model, cut)
            held += np.concatenate([starts, moves.ravel(), emitted.ravel(), [total]])
        some = np.flatnonzero(held)
        yield pd.DataFrame({"at": some, "held": held[some]})

    summed = docs.select("classes").mapInPandas(run, "at bigint, held double").groupBy("at").agg(F.sum("held").alias("held"))
    counts = np.zeros(size + 1)  # the model's size bounds what is collected
    rows = summed.toPandas()
    counts[rows["at"].to_numpy(np.int64)] = rows["held"].to_numpy()
    starts, moves, emitted = np.split(counts[:-1], [states, states + states * states])
    seen = float(emitted.sum())
    prior = np.log(model.start).sum() + np.log(model.moves).sum() + PRIOR * (shares * np.log(model.emits)).sum()
    starts, moves = starts + 1, moves.reshape(states, states) + 1
    emitted = emitted.reshape(states, CLASSES) + PRIOR * shares
    after = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True))
    return after, float(counts[-1] + prior), seen


def train(docs: DataFrame, shares: np.ndarray) -> tuple[Model, list[float]]:
    """Baum-Welch over all of `docs` (classes), until a round gains little; and the log likelihood of the model before each
    round, its prior included, which never falls. Without documents the model is its prior."""
    model, likelihoods = first_model(shares), []
    for _ in range(ROUNDS):
        model, likelihood, seen = _round(docs, model, shares)
        likelihoods.append(likelihood)
        if not seen or (len(likelihoods) > 1 and likelihood - likelihoods[-2] < GAIN * seen):
            break
    return model, likelihoods


def score(df: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `df`.

    Learns from the rows that are not held out. Tokens are words, A-Z lower-cased, then one end; null and empty
    texts are an end alone. `base_score` is the smoothed unigram's log10 probability, `score` the model's.
    Repeated rows count and are scored each by itself; a null id is never held out; without training rows
    every word is unknown. Other columns are ignored; an empty table gives an empty one.
    """
    rows = df.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(text_column).cast("string").alias("text"),
        held_out.alias("held"),
    )
    path = fresh_path(df.sparkSession, "hmm-coded")
    rows.mapInPandas(_coded, _CODED).write.option("compression", "zstd").parquet(path)
    coded = df.sparkSession.read.schema(_CODED).parquet(path)
    docs, dictionaries = coded.filter("classes IS NOT NULL"), coded.filter("words IS NOT NULL")
    posts = dictionaries.select(
        "chunk", F.posexplode(F.arrays_zip("words", "seen", "word_classes")).alias("place", "w")
    ).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.seen").alias("seen"), F.col("w.word_classes").alias("class"))
    counts = materialize(
        posts.groupBy("word").agg(F.sum("seen").alias("count"), F.first("class").alias("class")), "hmm-counts"
    )
    by_class = counts.groupBy("class").agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).toPandas()
    held, kinds = np.zeros(CLASSES), np.zeros(CLASSES)  # one row per class
    held[by_class["class"].to_numpy(np.int64)] = by_class["n"].to_numpy()
    kinds[by_class["class"].to_numpy(np.int64)] = by_class["v"].to_numpy()
    tokens, distinct = int(held.sum()), int(kinds.sum())
    shares = (held + 0.5) / (tokens + 0.5 * CLASSES)
    model, _ = train(docs.filter("NOT held").select("classes"), shares)
    below = np.log10(held + 0.5 * (kinds + 1))
    base_below = np.log10(tokens + 0.5 * (distinct + 1))

    def run(key, texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(len(known), np.int64)
        count[known["place"].to_numpy()] = known["count"].to_numpy()
        kind = np.zeros(len(known), np.int64)
        kind[known["place"].to_numpy()] = known["class"].to_numpy()
        tops = np.log10(count + 0.5)
        numbers = [np.frombuffer(blob, np.int32) for blob in texts["tokens"]]
        sequences = [kind[at] for at in numbers]
        out = np.zeros((len(texts), 2))
        n_known = np.zeros(len(texts), np.int64)
        for i, (at, classes) in enumerate(zip(numbers, sequences, strict=True)):
            top = tops[at]
            out[i, 0] = (top - base_below).sum()
            out[i, 1] = (top - below[classes])[:-1].sum()  # an end is the only word of its class
            n_known[i] = (count[at] > 0).sum()
        return pd.DataFrame(
            {
                "id": texts["id"].astype("Int64"),
                "held": texts["held"],
                "n_tokens": list(map(len, sequences)),
                "n_known": n_known,
                "base_score": out[:, 0],
                "score": out[:, 1] + log_likelihoods(model, sequences) / np.log(10),
            }
        )

    replies = posts.select("chunk", "place", "word").join(counts, "word").select(
        F.col("chunk").alias("of_chunk"), "place", "count", "class"
    )
    scored = (
        docs.select("chunk", "id", "held", "tokens")
        .groupBy("chunk")
        .cogroup(replies.groupBy("of_chunk"))
        .applyInPandas(
            run, "id bigint, held boolean, n_tokens bigint, n_known bigint, base_score double, score double"
        )
    )
    return scored.select(
        F.col("id").alias(id_column),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
