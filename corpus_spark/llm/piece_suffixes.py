"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words (runs of spaces with what follows, since no piece goes on after a space) are put one behind the
other and their suffixes sorted. Every piece is found by binary search as one range of suffixes; the ranges become
edges (start, end, piece), the edges are sorted by the place where they end, and relaxed in that order: a place's last
token is the longest piece whose predecessor, the last token at its start, would not have merged across the border. For
ranked merges that is exactly the result of merging, so ids equal those of the library; texts come back
by joining pieces.

The model's pieces are read once on the driver; their number is fixed by the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.wordhash import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 2_500_000
WINDOW, STRIDE = 160, 96  # bytes; longer words are encoded in windows that overlap
CACHE_BITS = 21
KEPT_UNITS = 400_000

_UNIT = re.compile(" +[^ ]*")
_SEPARATOR = 0xFF  # in no UTF-8 text
_WIDTH = 8
_FREE = np.iinfo(np.int32).max


class Pieces:
    """A ranked-merge model: its pieces, how each was merged last, and which neighbours merge."""

    def __init__(self, rows: list[tuple[int, str, float]], byte_ids: list[int]) -> None:
        self.rows, self.byte_ids = rows, byte_ids  # (id, text, score); the highest score merges first
        self._ready = False

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        skip = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        rows = [(i, model.id_to_piece(i).replace("▁", " "), model.get_score(i)) for i in ids if not skip[i]]
        return cls(rows, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "byte_ids": self.byte_ids, "_ready": False}

    def prepare(self) -> None:
        if self._ready:
            return
        known = {text: i for i, text, _ in self.rows}
        order = {score: k for k, score in enumerate(sorted({score for _, _, score in self.rows}, reverse=True))}
        rank_of = {i: order[score] for i, _, score in self.rows}
        size = max([0, *known.values(), *self.byte_ids]) + 2
        self.unknown = size - 1  # a character without a piece; its bytes are written instead
        self.rank = np.full(size, -1, np.int32)
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        pairs: dict[tuple[int, int], int] = {}
        reached = []
        for i, text, _ in self.rows:
            for at in range(1, len(text)):
                a, b = known.get(text[:at]), known.get(text[at:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        for i, text, _ in self.rows:
            if len(text) > 1:
                split = self._last_merge([known.get(c) for c in text], pairs, rank_of)
                if split is None or pairs.get(split) != i:
                    continue  # no sequence of merges makes it
                self.rank[i] = rank_of[i]
                self.left[i], self.right[i] = split
            reached.append((i, text.encode()))
        self.pairs = pairs
        self.pair_keys = np.array(sorted(a << 32 | b for a, b in pairs), np.int64)
        self.pair_ranks = np.array([rank_of[pairs[k >> 32, k & 0xFFFFFFFF]] for k in self.pair_keys.tolist()], np.int32)
        self.ids = np.array([i for i, _ in reached], np.int32)
        self.content = [b for _, b in reached]
        self.lengths = np.array([len(b) for b in self.content], np.int32)
        self.single = np.array([len(b.decode()) == 1 for b in self.content], bool)
        padded = [b[:_WIDTH].ljust(_WIDTH, b"\0") for b in self.content]
        topped = [b[:_WIDTH].ljust(_WIDTH, b"\xff") for b in self.content]
        self.low, self.high = (np.frombuffer(b"".join(x), ">u8").astype(np.uint64) for x in (padded, topped))
        most = int(self.lengths.max(initial=1))
        whole = b"".join(b.ljust(most, b"\0") for b in self.content)
        self.padded = np.frombuffer(whole, np.uint8).reshape(-1, most)
        self.cache_keys = np.full(1 << CACHE_BITS, -1, np.int64)
        self.cache_values = np.zeros(1 << CACHE_BITS, bool)
        self.as_bytes = np.full(size, b"", object)
        for i, text, _ in self.rows:
            self.as_bytes[i] = text.encode()
        for value, i in enumerate(self.byte_ids):
            self.as_bytes[i] = bytes([value])
        self._ready = True

    @staticmethod
    def _last_merge(symbols: list, pairs: dict[tuple[int, int], int], rank_of: dict[int, int]) -> tuple | None:
        """The two parts that the last of a piece's own merges joins; of equal ranks the leftmost goes first."""
        while len(symbols) > 1:
            made = [pairs.get(p) for p in zip(symbols[:-1], symbols[1:], strict=True)]
            options = [(rank_of[m], k) for k, m in enumerate(made) if m is not None]
            if not options:
                return None
            if len(symbols) == 2:
                return symbols[0], symbols[1]
            k = min(options)[1]
            symbols = [*symbols[:k], made[k], *symbols[k + 2 :]]
        return None

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which neighbours merge, or a number above all ranks."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _FREE)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b side by side stay apart: at no moment of making them do their parts merge.

        Both are taken apart again, the later merge first. Parts that touch would have merged if their
        rank comes before the merges that took them away; a draw goes to the one on the left.
        """
        out = np.ones(len(a), bool)
        where = np.arange(len(a))
        limit = np.full(len(a), _FREE, np.int64)
        while len(where):
            merges = self._merged(a, b) < limit
            out[where[merges]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~merges & ((ra >= 0) | (rb >= 0))
            where, a, b, ra, rb = where[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb.astype(np.int64) + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_apart` with a direct-mapped cache, since a corpus repeats its pairs."""
        key = a.astype(np.int64) << 32 | b
        slot = (key * 0x9E3779B97F4A7 >> 24) & ((1 << CACHE_BITS) - 1)
        hit = self.cache_keys[slot] == key
        out = self.cache_values[slot]
        missed = np.flatnonzero(~hit)
        if len(missed):
            fresh, back = np.unique(key[missed], return_inverse=True)
            value = self._apart((fresh >> 32).astype(np.int32), (fresh & 0xFFFFFFFF).astype(np.int32))
            out[missed] = value[back]
            self.cache_keys[slot[missed]] = key[missed]
            self.cache_values[slot[missed]] = out[missed]
            # Two keys of one slot: whichever was written, its value is written again beside it.
            wrong = self.cache_keys[slot[missed]] != key[missed]
            self.cache_keys[slot[missed[wrong]]] = -1
        return out


def _edges(pieces: Pieces, buffer: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, token) of every occurrence of every piece, from the sorted suffixes.

    Suffixes are sorted by their first _WIDTH bytes; the range of a longer piece is verified byte by byte."""
    n = len(buffer) - 2 * _WIDTH
    keys = np.zeros(n, np.uint64)
    for i in range(_WIDTH):
        keys = keys << np.uint64(8) | buffer[i : i + n]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.searchsorted(keys, pieces.low, "left")
    counts = np.searchsorted(keys, pieces.high, "right") - first
    which = np.repeat(np.arange(len(counts)), counts)
    start = order[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(which))]
    length = pieces.lengths[which]
    keep = np.ones(len(which), bool)
    left = np.flatnonzero(length > _WIDTH)
    for i in range(_WIDTH, int(pieces.lengths.max(initial=0))):
        left = left[length[left] > i]
        keep[left] &= buffer[np.minimum(start[left] + i, len(buffer) - 1)] == pieces.padded[which[left], i]
        left = left[keep[left]]
    start, length, which = start[keep], length[keep], which[keep]
    covered = np.zeros(n, bool)
    covered[start[pieces.single[which]]] = True
    lead = buffer[:n]
    bare = np.flatnonzero(((lead & 0xC0) != 0x80) & (lead != _SEPARATOR) & ~covered)
    size = 1 + (buffer[bare] >= 0xC0).astype(np.int32) + (buffer[bare] >= 0xE0) + (buffer[bare] >= 0xF0)
    tokens = np.concatenate([pieces.ids[which], np.full(len(bare), pieces.unknown, np.int32)])
    return np.concatenate([start, bare]), np.concatenate([length, size]), tokens


def encode_units(pieces: Pieces, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units one behind the other, where each unit's begin, with the end)."""
    pieces.prepare()
    encoded = [u.encode("utf-8", "surrogatepass") for u in units]
    buffer = np.frombuffer(b"\xff".join([*encoded, b""]), np.uint8)
    sizes = np.array(list(map(len, encoded)), np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    unit, start, end = _windows(buffer, begins, sizes)
    tokens = _encode_windows(pieces, buffer, start, end)
    while True:
        keep, torn = _joined(*tokens[:3], unit, start)
        if not torn.any():
            break
        # Neighbours without a common token become one window, with as much again behind them, since what doesn't
        # fall into step (a run of one character, say) may go on; all others stay as they are.
        at = np.flatnonzero(torn)
        reach = at + (end[at - 1] - start[at - 1]) // STRIDE
        deep = np.bincount(at, minlength=len(unit) + 1) - np.bincount(np.minimum(reach, len(unit)), minlength=len(unit) + 1)
        torn = (np.cumsum(deep)[:-1] > 0) & np.append(False, unit[1:] == unit[:-1])
        group = np.cumsum(~torn) - 1
        heads = np.flatnonzero(~torn)
        tails = np.append(heads[1:], len(unit)) - 1
        whole = tails == heads
        stays = whole[group[tokens[0]]]
        again = np.flatnonzero(~whole)
        unit, start, end = unit[heads], start[heads], end[tails]
        fresh = _encode_windows(pieces, buffer, start[again], end[again])
        fresh = (again[fresh[0]], *fresh[1:])
        tokens = (group[tokens[0]], *tokens[1:])
        tokens = tuple(np.concatenate([old[stays], new]) for old, new in zip(tokens, fresh, strict=True))
    window, at, size, token = (x[keep] for x in tokens)
    return _spread(pieces, unit[window], at, size, token, buffer, len(units))


def _windows(buffer: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, end) in the buffer: short units whole, long ones in windows of whole characters."""
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    unit = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[unit] + nth * STRIDE
    end = np.where(nth == counts[unit] - 1, begins[unit] + sizes[unit], start + WINDOW)
    for _ in range(3):  # a character's first byte is at most three bytes back
        start -= (buffer[start] & 0xC0) == 0x80
        end -= (buffer[end] & 0xC0) == 0x80
    return unit, start, end


def _encode_windows(
    pieces: Pieces, buffer: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, place in the buffer, length, token) of all windows' own encodings, in order."""
    raw = b"\xff".join([*(buffer[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)), b"\xff" * (2 * _WIDTH)])
    own = np.frombuffer(raw, np.uint8)
    sizes = end - start
    begins = np.cumsum(sizes + 1) - sizes - 1
    at, length, token = _edges(pieces, own, raw)
    window = np.repeat(np.arange(len(start)), sizes + 1)[at]
    offset = at - begins[window]
    order = np.argsort((offset + length) * 64 - length, kind="stable")
    at, length, token, offset, window = (x[order] for x in (at, length, token, offset, window))
    last = np.full(len(own) + 1, -1, np.int32)
    short = sizes[window] <= WINDOW
    _relax(pieces, last, *(x[short] for x in (at, length, token, offset)))
    rest = np.flatnonzero(~short)
    if len(rest):
        rest = rest[np.argsort(at[rest] + length[rest], kind="stable")]
        _relax_one_by_one(pieces, last, *(x[rest].tolist() for x in (at, length, token, offset)))
    window, at, size, token = _read_back(pieces, last, begins, sizes, own)
    return window, at - begins[window] + start[window], size, token


def _joined(
    window: np.ndarray, at: np.ndarray, size: np.ndarray, unit: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(the tokens to take, in order; which windows have no token in common with the one before them).

    An encoding is right where all its neighbours stay apart. So two windows' encodings that share a token make one: the
    first's tokens before it and the second's from it on, since every pair of neighbours comes from one of them.
    """
    follows = np.append(False, unit[1:] == unit[:-1])
    cut = np.full(len(unit) + 1, np.iinfo(np.int64).max)  # where the next window takes over
    if follows.any():
        twice = follows | np.append(follows[1:], False)
        some = np.flatnonzero(twice[window])
        key = at[some] * 64 + size[some]
        some = some[np.lexsort((window[some], key))]
        same = np.flatnonzero((at[some][1:] == at[some][:-1]) & (size[some][1:] == size[some][:-1]))[::-1]
        cut[window[some[same]]] = at[some[same]]  # backwards, so that the first common token counts
    torn = follows & (cut[:-1] == cut[-1])[np.arange(len(unit)) - 1]
    came = np.where(follows, cut[np.arange(len(unit)) - 1], start)
    keep = np.flatnonzero((at < cut[window]) & (at >= came[window]))
    return keep[np.argsort(at[keep], kind="stable")], torn


def _relax(pieces: Pieces, last: np.ndarray, start: np.ndarray, length: np.ndarray, token: np.ndarray, offset: np.ndarray) -> None:
    """All words at once, one end and length after the other, longest first."""
    steps = (offset + length) * 64 - length
    cuts = np.flatnonzero(np.concatenate([[True], steps[1:] != steps[:-1], [True]])) if len(steps) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        end = start[a:b] + length[a:b]
        free = np.flatnonzero(last[end] < 0)
        at, tok = start[a:b][free], token[a:b][free]
        good = offset[a:b][free] == 0
        inner = np.flatnonzero(~good)
        before = last[at[inner]]
        # An inner place without a token is inside a character or after an unreachable piece.
        before_ok = before >= 0
        inner, before = inner[before_ok], before[before_ok]
        good[inner] = pieces.apart(before, tok[inner])
        last[end[free[good]]] = tok[good]


def _relax_one_by_one(pieces: Pieces, last: np.ndarray, start: list, length: list, token: list, offset: list) -> None:
    known: dict[tuple[int, int], bool] = {}
    for at, size, tok, off in zip(start, length, token, offset, strict=True):
        if last[at + size] >= 0:
            continue
        if off:
            before = int(last[at])
            if before < 0:
                continue
            fits = known.get((before, tok))
            if fits is None:
                pair = (np.array([x], np.int32) for x in (before, tok))
                fits = known[before, tok] = bool(pieces.apart(*pair)[0])
            if not fits:
                continue
        last[at + size] = tok


def _read_back(
    pieces: Pieces, last: np.ndarray, begins: np.ndarray, sizes: np.ndarray, buffer: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, length, token) of all words' tokens in order: follows last tokens from every word's end to its start."""
    width = np.zeros(pieces.unknown + 1, np.int64)
    width[pieces.ids] = pieces.lengths
    unit, at, steps = np.arange(len(begins)), begins + sizes, []
    while len(unit):
        live = at > begins[unit]
        unit, at = unit[live], at[live]
        if not len(unit):
            break
        tok = last[at]
        size = width[tok]
        bare = np.flatnonzero(tok == pieces.unknown)
        for back in range(1, 5):  # a character's first byte is at most four bytes back
            starts = at[bare] - back
            size[bare] = np.where((size[bare] == 0) & ((buffer[starts] & 0xC0) != 0x80), back, size[bare])
        at = at - size
        steps.append((unit, at, size, tok))
    if not steps:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    unit, at, size, tok = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(at, kind="stable")  # words lie one behind the other
    return unit[order], at[order], size[order], tok[order]


def _spread(
    pieces: Pieces, unit: np.ndarray, at: np.ndarray, size: np.ndarray, tok: np.ndarray, buffer: np.ndarray, units: int
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each unit's begin, with the end): characters without a piece become their bytes' ids."""
    bare = tok == pieces.unknown
    copies = np.where(bare, size, 1)
    ids, owner = np.repeat(tok, copies), np.repeat(unit, copies)
    if bare.any():
        within = np.arange(len(ids)) - np.repeat(np.cumsum(copies) - copies, copies)
        spread = np.repeat(bare, copies)
        values = buffer[(np.repeat(at, copies) + within)[spread]]
        ids[spread] = np.array(pieces.byte_ids, np.int32)[values]
    counts = np.bincount(owner, minlength=units)
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Encodes batch after batch; words met before keep their ids, until KEPT_UNITS of them are held."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, where each text's begin, with the end)."""
        if len(self.codes) > KEPT_UNITS:
            self._clear()
        codes, known = self.codes, len(self.codes)
        sequence: list[int] = []
        ends = [0]
        for text in texts:
            if text:
                normal = " " + text.replace("▁", " ")
                sequence.extend([codes.setdefault(u, len(codes)) for u in _UNIT.findall(normal)])
            ends.append(len(sequence))
        if len(codes) > known:
            ids, begins = encode_units(self.pieces, list(islice(codes, known, None)))
            self.begins = np.concatenate([self.begins, self.begins[-1] + begins[1:]])
            self.ids = np.concatenate([self.ids, ids])
        units = np.array(sequence, np.int64)
        counts = np.diff(self.begins)[units]
        through = np.concatenate([[0], np.cumsum(counts)])
        where = np.repeat(self.begins[units] - through[:-1], counts) + np.arange(through[-1])
        return self.ids[where], through[np.array(ends)]


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """Pieces joined, without the space that encoding puts in front."""
    pieces.prepare()
    joined = b"".join(pieces.as_bytes[ids].tolist())
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def encode(df: DataFrame, pieces: Pieces, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_tokens, token_ids, round_trip) per row of `df`.

    Null and empty texts have no tokens. `round_trip` is whether decoding gives the text back: always, but for texts
    that hold U+2581 (the model's own sign for a space) or a lone surrogate. Repeated rows are encoded each; other
    columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, BATCH_CHARS):
                ids, ends = encoder.encode(texts[a:b])
                same = [decode_ids(pieces, ids[ends[i] : ends[i + 1]]) == (texts[a + i] or "") for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(same, pa.bool_()),
                    ],
                    ["id", "n_tokens", "token_ids", "round_trip"],
                )

    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean"
    ).withColumnRenamed("id", id_column)


def decode(df: DataFrame, pieces: Pieces, ids_column: str = "token_ids", text_column: str = "text") -> DataFrame:
    """`df` with the text of `ids_column`; null ids give a null text, unknown ids nothing."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda ids: None if ids is None else decode_ids(pieces, np.asarray(ids, np.int64)))

    return df.withColumn(text_column, decoded(F.col(ids_column)))
