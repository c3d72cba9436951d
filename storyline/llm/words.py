"""Words and word shingles of whole Arrow batches, as keyed 64-bit hashes, with numpy.

Bytes are read eight at a time.  A span's hash is a multilinear form of its 32-bit
halves with secret multipliers (:class:`Key`), twice: whatever two different texts
are, they share both sums with a probability of 2^-66 at most over the draw of the
key, which is made for each run, so nobody can make texts that collide.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Bytes of texts that are handled together, and lanes from which a span is summed up on its own.
GROUP, MANY_LANES = 1 << 21, 32
WORDS = 5
#: Bits of a shingle's hash that hold its rank by length; see :func:`shingles`.
RANK_BITS = 6
LOW = np.uint64(0xFFFFFFFF)
#: What is kept of a lane of which so many bytes belong to the span.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def new_key() -> int:
    """A secret of 128 bits; drawn once for a run and sent along with its functions."""
    return secrets.randbits(128)


@lru_cache(maxsize=4)
def _multipliers(key: int, row: int, n: int) -> np.ndarray:
    """n multipliers of 64 bits (a longer table begins with the shorter one)."""
    generator = np.random.Philox(key=[key & (1 << 64) - 1, (key >> 64) ^ row])
    return np.random.Generator(generator).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def multipliers(key: int, row: int, n: int) -> np.ndarray:
    return _multipliers(key, row, max(256, 1 << (n - 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text begins (nulls are empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Spans:
    """Spans [begin, end) of bytes, read in lanes of eight."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        self.view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        self.begin, self.length = begin, end - begin

    def lane(self, j: int, which: np.ndarray) -> np.ndarray:
        """Bytes 8 j to 8 j + 7 of the spans ``which``, zeros beyond their end."""
        return self.view[self.begin[which] + 8 * j] & MASKS[np.clip(self.length[which] - 8 * j, 0, 8)]

    def hashes(self, key: int, row: int = 0) -> np.ndarray:
        """One multilinear sum for each span, with the key's multipliers of this row."""
        most = int(self.length.max()) if len(self.length) else 0
        short = min(MANY_LANES, (most + 7) // 8)
        k = multipliers(key, row, 2 * (most + 7) // 8 + 3)
        out = self.length.astype(np.uint64) * k[0]
        which = np.flatnonzero(self.length > 0)
        for j in range(short):
            lane = self.lane(j, which)
            out[which] += (lane & LOW) * k[2 * j + 1] + (lane >> np.uint64(32)) * k[2 * j + 2]
            which = which[self.length[which] > 8 * (j + 1)]
        for i in which.tolist():
            lanes = self.view[int(self.begin[i]) : int(self.begin[i]) + int(self.length[i]) : 8].copy()
            if self.length[i] % 8:
                lanes[-1] &= MASKS[self.length[i] % 8]
            lanes, more = lanes[short:], k[2 * short + 1 : 2 * len(lanes) + 1]
            out[i : i + 1] += ((lanes & LOW) * more[::2] + (lanes >> np.uint64(32)) * more[1::2]).sum(dtype=np.uint64)
        return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run without white space within a text."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    word = ~WHITE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def shingles(texts: pa.Array, key: int, words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending.  Hashes of one key are comparable.

    A text with fewer than ``words`` words has the whole sequence as one, a text
    without words has none.  The highest bits rank a shingle by its bytes, the
    longest first: long words are rare, so ascending order puts shingles that
    few documents share in front without any count.
    """
    for data, offsets in groups(*buffers(texts)):
        yield from _shingles(data, offsets, key, words)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First and last + 1 of neighbouring texts of about ``size`` bytes together (one at least)."""
    _, offsets = buffers(texts)
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield start, end
        start = end


def groups(data: np.ndarray, offsets: np.ndarray, size: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of about ``size`` bytes together, so that memory is bounded by the longest text, not by the batch."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def _shingles(data: np.ndarray, offsets: np.ndarray, key: int, words: int) -> Iterator[np.ndarray]:
    begin, end = word_spans(data, offsets)
    spans, at = Spans(LOWERED[data], begin, end), np.searchsorted(begin, offsets)
    lengths = spans.length.astype(np.uint64)
    sums = [spans.hashes(key, row) for row in (0, 1)]
    pieces = [x for h in sums for x in (h & LOW, h >> np.uint64(32))]
    weights = multipliers(key, 2, 4 * words + 1)
    n = max(0, len(lengths) - words + 1)
    all_, size = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(words):
        for j, piece in enumerate(pieces):
            all_ += piece[i : i + n] * weights[4 * i + j]
        size += lengths[i : i + n]
    top = (1 << RANK_BITS) - 1
    rank = np.uint64(top) - np.minimum(size, np.uint64(top))
    all_ = rank << np.uint64(64 - RANK_BITS) | mixed(all_) >> np.uint64(RANK_BITS)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= words:
            yield np.unique(all_[i : j - words + 1])
        elif j > i:
            some = sum(int(x) * int(weights[4 * k + p]) for p, piece in enumerate(pieces) for k, x in enumerate(piece[i:j].tolist()))
            some = np.array([(some + (j - i) * int(weights[4 * words])) % (1 << 64)], dtype=np.uint64)
            yield mixed(some) >> np.uint64(RANK_BITS)
        else:
            yield np.zeros(0, dtype=np.uint64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrays as one Arrow list array, without Python values."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, type=kind))
