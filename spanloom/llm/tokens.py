"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

A word is a run of ASCII letters, digits and all bytes from 0x80 on, in UTF-8; ASCII letters
are lower-cased. The hash of a word is the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 18  # bytes of texts that are hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


BYTES = np.arange(256)
WORD = (BYTES >= 128) | ((BYTES >= 48) & (BYTES < 58)) | ((BYTES | 32) >= 97) & ((BYTES | 32) < 123)
RAW = numbers(256, 1)  # a value for each byte
FOLDED = RAW[np.where((BYTES >= 65) & (BYTES < 91), BYTES + 32, BYTES)]
STEP = numbers(64, 2)  # a factor for each place in a shingle
_powers: tuple[np.ndarray, ...] = ()


def powers(n: int) -> tuple[np.ndarray, ...]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i from 0 to n - 1 at least.

    Those for a piece are kept; more of them only live as long as they are used.
    """
    global _powers
    if _powers and n <= len(_powers[0]):
        return _powers
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        run = np.full(max(n, PIECE + 1024), base, np.uint64)
        run[0] = 1
        both.append(np.cumprod(run))
    if n <= PIECE + 1024:
        _powers = tuple(both)
    return tuple(both)


class Spans:
    """Hashes of any byte ranges of a buffer, each in constant time."""

    def __init__(self, data: np.ndarray, value: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or of one row."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = max(high, low + 1)
        yield low, high
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text its first word (n + 1 numbers)."""
    inside = WORD[data]
    joined = inside[1:] & inside[:-1]  # place i goes on in place i + 1
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    joined[borders - 1] = False
    before, after = inside.copy(), inside.copy()
    before[1:] &= ~joined
    after[:-1] &= ~joined
    start = np.flatnonzero(before)
    return start, np.flatnonzero(after) + 1, np.searchsorted(start, offsets)


def word_parts(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in parts of at most about `most` bytes, cut between words: the number of the first text
    of a part, its bytes, and the offsets of its texts in them. Only a word can make a part longer."""
    most = most or 2 * PIECE
    begin = 0
    while True:
        end = begin + most
        if end >= len(data):
            end = len(data)
        else:
            while end < len(data):
                gap = np.flatnonzero(~WORD[data[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, len(data))
        low = max(0, int(np.searchsorted(offsets, begin, "right")) - 1)
        high = max(low + 1, int(np.searchsorted(offsets, end, "left")))
        high = len(offsets) - 1 if end == len(data) else high
        yield low, data[begin:end], np.clip(offsets[low : high + 1], begin, end) - begin
        if end == len(data):
            return
        begin = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text its first word (n + 1 numbers)."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for low, part, inner in word_parts(data, offsets):
        start, end, first = word_spans(part, inner)
        hashes.append(Spans(part, FOLDED).hash(start, end))
        counts[low : low + len(inner) - 1] += np.diff(first)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of `size` words, and for each text its first (n + 1 numbers).

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    at = np.arange(len(words))
    total = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        total += np.where(at + j < ends, padded[j : j + len(words)] * STEP[j], np.uint64(0))
    whole = at + size <= ends
    short = first[:-1][(counts > 0) & (counts < size)]
    whole[short] = True
    kept = np.flatnonzero(whole)
    return mix(total[kept]), np.searchsorted(kept, first)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 63-bit hashes of its word shingles.

    A text with bytes but no words has one shingle, of its bytes; an empty one has none.
    """
    data, offsets = buffer_of(column)
    for low, high in pieces(offsets):
        part, inner = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        words, first = word_hashes(part, inner)
        hashes, begin = shingle_hashes(words, first, size)
        hashes = hashes >> np.uint64(1)
        for i in range(high - low):
            if begin[i] == begin[i + 1] and inner[i] < inner[i + 1]:
                one = Spans(part[inner[i] : inner[i + 1]], RAW)
                end = np.array([inner[i + 1] - inner[i]])
                yield one.hash(np.array([0]), end) >> np.uint64(1)
            else:
                yield np.unique(hashes[begin[i] : begin[i + 1]])
