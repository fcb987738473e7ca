"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A word's hash is a polynomial sum over
its bytes with a random value per byte, so equal words have equal hashes everywhere and different
ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 400_000

_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SHINGLE = _random.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about `limit` characters; one long text is its own range."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: hashes, byte spans in `buffer`, and where each text's words begin."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
        self.buffer = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        space = _SPACE[self.buffer]
        inside = ~space
        before = np.empty_like(space)
        before[:1] = True
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(inside & before)
        after = np.empty_like(space)
        after[-1:] = True
        after[:-1] = space[1:]
        self.ends = np.flatnonzero(inside & after) + 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.offsets = np.searchsorted(self.starts, first)
        self.hashes = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        where = np.flatnonzero(inside)
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(len(where)) - np.repeat(firsts, lengths)
        power = np.full(int(lengths.max()), _STEP, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        values = _BYTE_VALUES[self.buffer[where]] * power[place]
        return mix(np.add.reduceat(values, firsts))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run as a whole."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        joined = np.uint64(n)
        for i in range(n):
            joined = mix(np.array([joined], np.uint64) * _SHINGLE[0] + words[i])[0]
        return np.array([joined], np.uint64)
    total = words[: n - size + 1] * _SHINGLE[0]
    for i in range(1, size):
        total = total + words[i : n - size + 1 + i] * _SHINGLE[i]
    return np.unique(mix(total))
