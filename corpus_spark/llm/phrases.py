"""Phrase collocations, counted in a dictionary of prefix-free parsing.

A text's words are cut into chunks behind each trigger word, one whose hash is a multiple of TRIGGER. A chunk carries
the next words behind its end as well, one fewer than the longest phrase has, so every n-gram lies whole in the chunk
that holds its first word, and is counted there and nowhere else. Where a chunk ends depends on its words alone:
passages that many texts share are the same chunks, and the dictionary holds each once, with how often the parse uses
it. n-grams are counted inside the dictionary's chunks with that weight.

Levels go from words to longer phrases. A phrase below the least count makes every phrase around it too rare, so a
level passes over n-grams whose parts are absent from a Bloom filter of the frequent phrases before it. The filter
has a fixed size; when it is crowded, more rare n-grams are counted and dropped afterwards, and results stay the same.

A chunk is written as words and breaks between pieces ("\\n") with a blank between any two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpus_spark.llm.wordhash import chunks, mix
from corpus_spark.session import materialize

WORDS = 3  # of the longest phrases
LEAST = 10
INSIDE_PERCENT = 50
TOP = 2000
TRIGGER = 16
LONGEST = 512  # words of a chunk without a trigger; counts are exact wherever a chunk is cut
HELD_BYTES = 8_000_000  # of chunks whose n-grams a task adds up before it sends them
FILTER_BITS = 1 << 27
SALTS = 64

_PIECE_END = np.zeros(256, bool)
_PIECE_END[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_VALUES = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.full(int(lengths.max()), _STEP, np.uint64)
    power[0] = 1
    values = _VALUES[buffer[np.repeat(starts, lengths) + place]] * np.multiply.accumulate(power)[place]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths))


def parse(
    texts: list[str | None], longest_phrase: int = WORDS, trigger: int = TRIGGER, longest: int = LONGEST
) -> tuple[list[int], list[str], list[int]]:
    """The chunks of some texts: (whose text, chunk, how many of its words and breaks are its own)."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    end_of_piece = _PIECE_END[buffer]
    inside = ~(end_of_piece | _BLANK[buffer])
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return [], [], []
    piece = np.cumsum(end_of_piece)[starts]
    text_starts = np.cumsum([0, *(len(e) + 1 for e in encoded[:-1])])
    owner = np.searchsorted(text_starts, starts, side="right") - 1
    same_piece, same_text = piece[1:] == piece[:-1], owner[1:] == owner[:-1]

    # The written form: every word and what stands before it (nothing, a blank, or a break).
    lengths = ends - starts
    gap = np.concatenate([[0], np.where(same_piece, 1, 3)])
    at = np.cumsum(lengths + gap) - lengths
    written = np.full(int(at[-1] + lengths[-1]), 0x20, np.uint8)
    written[at[1:][~same_piece] - 2] = 0x0A
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    written[np.repeat(at, lengths) + place] = buffer[np.repeat(starts, lengths) + place]

    cut = _word_hashes(buffer, starts, ends) % np.uint64(trigger) == 0
    cut[:-1] |= ~same_text
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    long = np.flatnonzero(last - first >= longest)
    if len(long):
        more = np.concatenate([np.arange(first[i] + longest - 1, last[i], longest) for i in long])
        last = np.sort(np.concatenate([last, more]))
        first = np.concatenate([[0], last[:-1] + 1])
    behind = np.zeros(len(last), np.int64)  # words behind the end, of the same piece
    going = np.ones(len(last), bool)
    for _ in range(longest_phrase - 1):
        following = last + behind + 1
        going &= following < n
        going[going] = same_piece[following[going] - 1]
        behind += going
    breaks = np.concatenate([[0], np.cumsum(~same_piece)])
    own = last - first + 1 + breaks[last] - breaks[first]
    final = last + behind
    whole = written.tobytes()
    found = [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[first], (at + lengths)[final], strict=True)]
    return owner[first].tolist(), found, own.tolist()


def dictionary(df: DataFrame, lang_column: str, text_column: str, longest_phrase: int) -> DataFrame:
    """(lang, chunk, own, uses): the distinct chunks of all texts and how often the parse uses each."""
    trigger, longest = TRIGGER, LONGEST

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
            for start, end in chunks(texts):
                owner, found, own = parse(texts[start:end], longest_phrase, trigger, longest)
                yield pd.DataFrame({"lang": langs[start:end][owner], "chunk": found, "own": own})

    rows = df.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    cuts = rows.filter("text <> ''").mapInPandas(cut, "lang string, chunk string, own int")
    return cuts.groupBy("lang", "chunk", "own").agg(F.count("*").alias("uses"))


def _hash_of(word_hashes: list[np.ndarray], lang: str) -> np.ndarray:
    """One hash a phrase, from the hashes of its words in order and its language."""
    total = np.full(len(word_hashes[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for h in word_hashes:
        total = mix(total * _STEP + h)
    return total


def _hashed(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _spots(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes % np.uint64(size), (hashes >> np.uint64(32)) % np.uint64(size)


class _Filter:
    """A Bloom filter's bits, as the workers see them."""

    def __init__(self, bits: Broadcast) -> None:
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits.value, np.uint8)
        found = np.ones(len(hashes), bool)
        for spot in _spots(hashes, 8 * len(bits)):
            found &= bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 == 1
        return found


def _filter_of(frequent: DataFrame) -> _Filter:
    """A filter of FILTER_BITS bits for (lang, phrase) rows, put together by Spark's bitmap functions."""
    size = FILTER_BITS

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column("lang"), batch.column("phrase")
            for lang in pc.unique(langs).to_pylist():
                mine = phrases.filter(pc.equal(langs, lang))
                words = pc.split_pattern(mine, " ")
                n = len(words[0])
                flat = _hashed(words.flatten()).reshape(len(words), n)
                spot = np.concatenate(_spots(_hash_of([flat[:, i] for i in range(n)], lang), size))
                # Spark numbers bits from 1.
                yield pa.RecordBatch.from_pydict({"spot": np.unique(spot).astype(np.int64) + 1})

    marked = (
        frequent.select("lang", "phrase")
        .mapInArrow(spots, "spot bigint")
        .groupBy(F.bitmap_bucket_number("spot").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    part_bytes = 4096
    bits = bytearray(size // 8)
    for row in marked.toLocalIterator():  # `size` bits in all, whatever the data
        start = (row["part"] - 1) * part_bytes
        bits[start : start + part_bytes] = row["bits"]
    return _Filter(frequent.sparkSession.sparkContext.broadcast(bytes(bits)))


def _grams(lang: str, chunk: pa.Array, own: np.ndarray, uses: np.ndarray, size: int, parts: _Filter | None) -> pa.RecordBatch | None:
    """The n-grams of `size` words in the chunks' own places, each distinct one with its sum of uses."""
    split = pc.split_pattern(chunk, " ")
    sizes = split.value_lengths().to_numpy(zero_copy_only=False)
    encoded = split.flatten().dictionary_encode()
    code, words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    n = len(code) - size + 1
    if n < 1:
        return None
    which = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    usable = pc.not_equal(words, "\n").to_numpy(zero_copy_only=False)[code]
    ok = (place < own[which])[:n] & (which[:n] == which[size - 1 :])
    for i in range(size):
        ok &= usable[i : n + i]
    at = np.flatnonzero(ok)
    if parts is not None and len(at):
        hashes = _hashed(words)
        for shift in (0, 1):
            at = at[parts.has(_hash_of([hashes[code[at + shift + i]] for i in range(size - 1)], lang))]
    if not len(at):
        return None
    key = code[at]
    for i in range(1, size):  # numbered anew at every step, so that keys stay below the square of the batch's words
        key = np.unique(key, return_inverse=True)[1] * len(words) + code[at + i]
    first, inverse = np.unique(key, return_index=True, return_inverse=True)[1:]
    total = np.zeros(len(first), np.int64)
    np.add.at(total, inverse, uses[which[at]])
    columns = [words.take(pa.array(code[at[first] + i])) for i in range(size)]
    phrase = pc.binary_join_element_wise(*columns, " ") if size > 1 else columns[0]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), phrase, pa.array(total)], ["lang", "phrase", "f"])


def _counted(parsed: DataFrame, size: int, parts: _Filter | None) -> DataFrame:
    """(lang, phrase, f) of all n-grams of `size` words whose parts the filter knows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            langs = table.column("lang")
            for lang in pc.unique(langs).to_pylist():
                mine = table.filter(pc.equal(langs, lang)).combine_chunks()
                chunk = mine.column("chunk").chunk(0)
                own, uses = mine.column("own").to_numpy(), mine.column("uses").to_numpy()
                found = _grams(lang, chunk, own, uses, size, parts)
                if found is not None:
                    yield found

    return parsed.mapInArrow(count, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _first_rows(df: DataFrame, key: str, order: list, top: int) -> DataFrame:
    """The first `top` rows of each key with their rank; parts of a key are cut first, so that none meets whole."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    least = df.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy(key, "part").orderBy(*order)))
    kept = least.filter(F.col("rank") <= top).drop("part")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= top)


def frequent_phrases(
    df: DataFrame, lang_column: str = "lang", text_column: str = "text", words: int = WORDS, least: int = LEAST
) -> DataFrame:
    """(lang, size, phrase, f): every word, with size 1, and every phrase of up to `words` words that occurs at least
    `least` times. Occurrences overlap and stay within pieces. A null text is empty, a null lang `und`."""
    parsed = materialize(dictionary(df, lang_column, text_column, words), "phrase-chunks")
    levels, parts = [], None
    for size in range(1, words + 1):
        level = _counted(parsed, size, parts)
        level = materialize(level if size == 1 else level.filter(F.col("f") >= least), f"phrases-{size}")
        levels.append(level.withColumn("size", F.lit(size)))
        if size < words:
            parts = _filter_of(level.filter(F.col("f") >= least))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select("lang", "size", "phrase", "f")


def _slice(start, length):
    return F.array_join(F.slice("w", start, length), " ")


def collocations(
    df: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    words: int = WORDS,
    least: int = LEAST,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    A phrase of 2 to `words` words that occurs a >= `least` times is scored at its worst cut into two parts that occur l and r times,
    floor(1000000 * a * a / (l * r)); ties go to the cut further left. Phrases that stand inside a longer candidate with
    100 * f(longer) >= `inside_percent` * a go. n counts the language's words. A null text is empty, a null lang
    is `und`; repeated rows count as often as they stand there; other columns are ignored; an empty table gives an empty one.
    """
    found = frequent_phrases(df, lang_column, text_column, words, least)
    total = found.filter("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    known = found.filter(F.col("f") >= least)
    candidates = known.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", _slice(F.lit(1), F.col("k")).alias("left"), _slice(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    part = known.select("lang", "phrase", "f")
    both = cut.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    score = F.call_function("div", wide["a"] * wide["a"] * F.lit(1_000_000), wide["l"] * wide["r"]).alias("score")
    worst = (
        both.select("lang", "phrase", "a", "k", "l", "r", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("best"))
        .select("lang", "phrase", "a", "best.*")
    )

    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _slice(i, m))))
    inner = (
        candidates.filter("size > 2")
        .select("lang", "a", F.explode(starts).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    inside = F.coalesce(100 * F.col("longer") >= inside_percent * F.col("a"), F.lit(False))
    left = worst.join(inner, ["lang", "phrase"], "left").filter(~inside)
    ranked = _first_rows(left, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score")
    )
