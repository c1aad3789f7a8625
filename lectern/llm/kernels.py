"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, which for UTF-8 text is
the same as ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are 64 bits wide and depend
on the bytes only, so they agree between tasks, runs and machines.

Where equal hashes are taken for equal words, texts are hostile input: `Words.keyed` hashes
words by SipHash in two lanes with keys of their own. `Words.hashes`, a polynomial whose
collisions can be written down, is for features and buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pandas.util import hash_array

U64 = np.uint64
#: Bytes of text hashed at once; bounds the working arrays whatever the batch size.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = 0x9FB21C651E98DF25  # odd
_GRAM = U64(0xD6E8FEB86659FD93)
#: SipHash keys of the lanes; 16 bytes each.
LANES = ("lectern words, 1", "lectern words, 2")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_STEP, 4096)


@dataclass
class Words:
    """The words of a slice of documents; word w of document d is first[d] + w."""

    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # byte offsets of the documents
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, with the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def tokens(self, lower: bool = False) -> np.ndarray:
        """The words as bytes objects."""
        raw = self.data.tobytes()
        if lower:
            raw = raw.lower()  # A-Z only
        held: list[bytes] = []
        edges = self.bounds.tolist()
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            held += raw[low:high].split()
        out = np.empty(len(held), dtype=object)
        out[:] = held
        return out

    def keyed(self, lane: int, lower: bool = False, tokens: np.ndarray | None = None) -> np.ndarray:
        """SipHash of each word under the lane's key."""
        tokens = self.tokens(lower) if tokens is None else tokens
        return hash_array(tokens, hash_key=LANES[lane], categorize=False) if len(tokens) else np.zeros(0, dtype=U64)

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, dtype=U64)
        size = self.end - self.start
        total = int(size.sum())
        at = np.cumsum(size) - size
        within = np.arange(total) - np.repeat(at, size)
        longest = int(size.max())
        table = _POWERS if longest <= len(_POWERS) else powers(_STEP, longest)
        value = (_BYTE_LOWER if lower else _BYTE)[self.data[within + np.repeat(self.start, size)]]
        value *= table[within]
        return mix(np.add.reduceat(value, at) + size.astype(U64))


def as_strings(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `most` bytes; null counts as empty."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> Words:
    word = ~space[data]
    before = np.empty_like(word)
    after = np.empty_like(word)
    if len(word):
        before[0] = after[-1] = False
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        cuts = bounds[1:-1]
        before[cuts[cuts < len(word)]] = False
        after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, across document borders too; one fewer than words for each further word.
    A run's hash joins those of its halves by `mix`, so it is no sum over its words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    done, width = None, 0  # the words taken so far
    part, size = hashes, 1  # part[i]: size words from i
    while True:
        if n & size:
            done = part if done is None else _joined(done, part[width:])
            width += size
        size *= 2
        if size > n:
            break
        part = _joined(part, part[size // 2 :])
    return mix(done[: len(hashes) - n + 1])


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    m = min(len(left), len(right))
    return mix(left[:m] ^ mix(right[:m] + _GRAM))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words, by the index of their first word, lie in one document."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return (left >= n)[: total - n + 1]
