"""Fill-in-middle: texts cut at two unit boundaries that a wavelet matrix over character classes locates.

Every code point has one of CLASSES classes, which say what it is and whether a word or the text ends with it. A
unit (word, line or character) ends where a code point has one of some classes, so the number of boundaries before a
place is a sum of ranks, and the k-th boundary is the least place whose sum reaches k: bisection on ranks. All
texts of a chunk share one matrix, and all their cuts are bisected together.

The cut text is a prefix, a middle and a suffix, rewritten with sentinels as `psm` (prefix, suffix, middle) or `spm`
(suffix, prefix, middle). Which cuts and which form a text gets is a hash of its id and the seed alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.syncmers import code_points
from corpus_spark.llm.wordhash import chunks

# What a code point is; LAST_* end the text, WORD_END ends a word that whitespace follows.
WORD, WORD_END, BLANK, NEWLINE, LAST_WORD, LAST_BLANK, LAST_NEWLINE = CLASSES = range(7)
LEVELS = 3
UNITS = {
    "word": (WORD_END, LAST_WORD, LAST_BLANK, LAST_NEWLINE),
    "line": (NEWLINE, LAST_WORD, LAST_BLANK, LAST_NEWLINE),
    "character": CLASSES,
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def classes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of every code point of concatenated texts; `ends` are the places of the texts' last ones."""
    newline = codes == 0x0A
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    out = np.where(newline, NEWLINE, np.where(blank, BLANK, WORD)).astype(np.uint8)
    followed = np.zeros(len(codes), bool)
    followed[:-1] = blank[1:]
    out[~blank & followed] = WORD_END
    out[ends] = np.where(newline[ends], LAST_NEWLINE, np.where(blank[ends], LAST_BLANK, LAST_WORD))
    return out


class _Bits:
    """A bit vector with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def ones(self, place: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """A sequence of small numbers, one bit vector a level, highest bit first; zeros of a level go before its ones."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.size = levels, len(values)
        self.bits, self.zeros = [], []
        for level in range(levels):
            bit = (values >> (levels - 1 - level)) & 1 == 1
            self.bits.append(_Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How often `value` stands before each place."""
        low, high = np.zeros_like(place), place
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            if value >> (self.levels - 1 - level) & 1:
                low, high = zeros + bits.ones(low), zeros + bits.ones(high)
            else:
                low, high = low - bits.ones(low), high - bits.ones(high)
        return high - low

    def boundaries(self, ending: Sequence[int], place: np.ndarray) -> np.ndarray:
        """How many values of `ending` stand before each place."""
        return sum((self.rank(v, place) for v in ending), np.zeros_like(place))

    def locate(self, ending: Sequence[int], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place of [low, high] with `wanted` boundaries before it, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.boundaries(ending, middle) >= wanted
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low


def cuts(texts: Sequence[str | None], first: np.ndarray, second: np.ndarray, unit: str) -> pd.DataFrame:
    """(n, a, b) per text: its number of units, and where its first a' and b' units end, a' <= b' being
    the two numbers modulo n + 1."""
    ending, out = UNITS[unit], np.zeros((len(texts), 3), np.int64)
    for start, end in chunks(texts):
        codes = [code_points(t or "") for t in texts[start:end]]
        lengths = np.fromiter((len(c) for c in codes), np.int64, len(codes))
        stop = np.cumsum(lengths)
        begin = stop - lengths
        joined = np.concatenate(codes)
        matrix = WaveletMatrix(classes(joined, stop[lengths > 0] - 1), LEVELS)
        base = matrix.boundaries(ending, begin)
        n = matrix.boundaries(ending, stop) - base
        chosen = np.sort(np.stack([first[start:end] % (n + 1), second[start:end] % (n + 1)]), axis=0)
        found = matrix.locate(ending, (base + chosen).ravel(), np.tile(begin, 2), np.tile(stop, 2)).reshape(2, -1) - begin
        out[start:end] = np.stack([n, *found], axis=1)
    return pd.DataFrame(out, columns=["n", "a", "b"])


def drawn(id_column: str, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of seed and id; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    unit: str = "word",
    seed: int = 42,
    rate: int = 50,
    spm: int = 80,
) -> DataFrame:
    """`df` with fim_form (`plain`, `psm` or `spm`), fim_text, fim_units, fim_prefix_chars and fim_middle_chars (code
    points, null where plain).

    `rate` of 100 texts are cut, `spm` of 100 cut ones get the suffix first. Units: a `word` is whitespace and the word
    after it, whitespace at the end being one of its own; a `line` ends with its newline. A null text is read as empty;
    empty texts and those that hold a sentinel stay plain. Rows with equal ids and texts get equal results, rows with
    a null id are drawn as the empty id. Columns of `df` with a name of these are replaced, all others pass through; an empty
    table gives an empty one.
    """

    @F.pandas_udf("n bigint, a bigint, b bigint")
    def located(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return cuts(text.tolist(), first.to_numpy(), second.to_numpy(), unit)

    text = F.coalesce(F.col(text_column), F.lit(""))
    draw = F.array(*drawn(id_column, seed))
    # One struct holds the caller's row, so no name of theirs meets one of ours.
    packed = df.select(F.struct("*").alias("row"), text.alias("text"), draw.alias("draw")).select(
        "row", "text", "draw", located("text", F.col("draw")[0], F.col("draw")[1]).alias("cut")
    )
    plain = (F.col("text") == "") | (F.col("draw")[2] % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(sentinel))
    form = F.when(plain, "plain").when(F.col("draw")[3] % 100 < spm, "spm").otherwise("psm")
    whole, a, b = F.col("text"), F.col("cut.a"), F.col("cut.b")
    prefix, middle = F.substring(whole, F.lit(1), a.cast("int")), F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substring(whole, (b + 1).cast("int"), F.char_length(whole))
    cut_text = (
        F.when(F.col("form") == "plain", whole)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    is_cut = F.col("form") != "plain"
    added = {
        "fim_form": F.col("form"),
        "fim_text": cut_text,
        "fim_units": F.col("cut.n"),
        "fim_prefix_chars": F.when(is_cut, a),
        "fim_middle_chars": F.when(is_cut, b - a),
    }
    return packed.withColumn("form", form).select(
        *[F.col("row")[c].alias(c) for c in df.columns if c not in added], *[e.alias(c) for c, e in added.items()]
    )


def restored(form: Column, text: Column) -> Column:
    """The text that `form` and a cut text say; null where either is null."""
    head = F.substring_index(text, MIDDLE, 1)
    middle = F.substring_index(text, MIDDLE, -1)
    psm_prefix = F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1)
    spm_suffix = F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1)
    return (
        F.when(form == "plain", text)
        .when(form == "psm", F.concat(psm_prefix, middle, F.substring_index(head, SUFFIX, -1)))
        .when(form == "spm", F.concat(F.substring_index(head, PREFIX, -1), middle, spm_suffix))
    )
