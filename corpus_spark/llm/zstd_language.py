"""Language identification by compression with per-language zstandard raw-content dictionaries.

A dictionary is plain text of one language. A text is encoded with each of them, in pieces of PIECE bytes so that a
long text can't become its own dictionary, and the language with the smallest total wins. Where the best two
are closer than MARGIN of the size, the text is rejected: no dictionary explains it better.

Learning takes a bounded sample per language: the SAMPLE_DOCS distinct texts with the smallest hash, an excerpt of
EXCERPT characters of each. Copies of a text are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNDETERMINED = "und"
SAMPLE_DOCS = 120
EXCERPT = 2000
PIECE = 16384
LEVEL = 6
MARGIN = 0.004
MARGIN_BYTES = 1

_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The lower-case text with a single space for every run of ASCII characters other than letters."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())


def _pieces(data: bytes) -> list[bytes]:
    count = max(1, -(-len(data) // PIECE))
    edges = [len(data) * i // count for i in range(count + 1)]
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Model:
    """Dictionaries by language, most frequent first, which also decides ties."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.dictionaries = dictionaries
        self._coders: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_coders": None}

    def coders(self) -> list[zstandard.ZstdCompressor]:
        if self._coders is None:
            self._coders = []
            for _, content in self.dictionaries:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
                self._coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **options))
        return self._coders

    def sizes(self, text: str) -> np.ndarray:
        pieces = _pieces(letters(text))
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.coders()])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not self.dictionaries or text is None or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        over = np.delete(sizes, best) - sizes[best]
        score = 1.0 / (1.0 + float(np.exp2(-np.minimum(over, 400) / 2.0).sum()))
        narrow = len(over) > 0 and over.min() < max(MARGIN_BYTES, MARGIN * sizes[best])
        return self.dictionaries[best][0], score, bool(narrow)


def learn(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Dictionaries from rows with a language and a text; languages number as many as the labels do."""
    rows = df.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    # Copies share a hash: hashes are made distinct and ranked first, then excerpts of the chosen ones are fetched.
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash"))
    chosen = hashed.select("lang", "hash").distinct().withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS)
    # An excerpt of a text starts at a place that its hash names.
    room = F.greatest(F.char_length("text") - EXCERPT, F.lit(0)) + 1
    excerpt = F.substring("text", (F.pmod("hash", room) + 1).cast("int"), F.lit(EXCERPT))
    # SAMPLE_DOCS rows a language at most, as many as are collected below.
    sample = (
        hashed.join(F.broadcast(chosen), ["lang", "hash"])
        .groupBy("lang", "hash", "rank")
        .agg(F.min(excerpt).alias("text"))
    )
    parts: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["rank"])):
        parts.setdefault(r["lang"], []).append(letters(r["text"]))
    ordered = sorted(parts, key=lambda lang: (-counts[lang], lang))
    return Model([(lang, b" ".join(parts[lang])) for lang in ordered])


def identify(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """`df` with lang_pred, lang_score (0 to 1) and lang_rejected.

    A null text and one without a letter is `und`, scores 0 and is rejected; so is every text if nothing was
    learned. Equal texts get equal answers; columns that have one of the three names are replaced, all others pass
    through; an empty table gives an empty one.
    """

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "lang_score", "lang_rejected"])

    answers = ("lang_pred", "lang_score", "lang_rejected")
    # Not moved by the optimizer: a filter on an answer would otherwise have its own evaluation below that of the result.
    predicted = predicted.asNondeterministic()
    rows = df.select(F.struct("*").alias("row"), predicted(F.col(text_column).cast("string")).alias("answer"))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in df.columns if c not in answers], *[F.col("answer")[c].alias(c) for c in answers]
    )
