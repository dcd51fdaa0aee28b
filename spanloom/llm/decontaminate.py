"""Benchmark leaks by spaced-seed hashing.

A seed is a window of words seen through a fixed mask that ignores some places, so a substituted
word at an ignored place still hits. Seeds of documents and benchmark items are joined by hash;
along each hit the two texts are compared word by word, and an overlap counts if enough words
agree, whichever of the others were substituted. The masks are chosen so that every overlap that
counts holds a seed: each stretch of n words with n // 4 substitutions at most has one, wherever
they are (tried out for all places up to twice the shortest stretch; a longer stretch has a part
of such a length with no larger share of substitutions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import STEP, buffer_of, mix, pieces, word_hashes

MASKS = ("111011", "110100011", "1001111", "111000101", "110111")  # for stretches of 9 words and more
SHORT_MASKS = ("11011", "1111", "1100011", "11101", "10111")  # for stretches of 4 words and more
SHORT = 12  # words; shorter items are sought with the short masks
LEAST_ITEM = 5  # words; shorter items are sought word for word, all words in a row
LEAST_WORDS = 13  # words that agree in an overlap; this share of the words of shorter items:
LEAST_SHARE = 0.75  # of the words of an overlap agree
PART = 1 << 20  # hits, or words along them, that are compared at a time
BLOCK_BYTES = 4 << 20  # of benchmark texts that one scan of the documents holds

LEAK = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, n_equal bigint"


def seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of a text that the mask fits into."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + len(mask) <= ends)
    total = np.zeros(n, np.uint64)
    for j, place in enumerate(places):
        total += words[place : place + n] * STEP[j]
    return at, mix(total[at])


class Block:
    """Items of the benchmark, as words and seeds; its size is bounded by the caller."""

    def __init__(self, item_ids: list[int], texts: list[bytes]):
        data, offsets = buffer_of(pa.array(texts, pa.large_binary()))
        self.words, self.first = word_hashes(data, offsets)
        self.item_ids = np.array(item_ids, np.int64)
        counts = np.diff(self.first)
        self.least = np.minimum(LEAST_WORDS, np.ceil(LEAST_SHARE * counts)).astype(np.int64)
        self.least = np.where(counts < LEAST_ITEM, counts, self.least)
        self.tables = []
        long, short = counts >= SHORT, (counts >= LEAST_ITEM) & (counts < SHORT)
        whole = [("1" * n, counts == n) for n in range(1, LEAST_ITEM)]
        for mask, item in [(m, long) for m in MASKS] + [(m, short) for m in SHORT_MASKS] + whole:
            at, keys = seeds(self.words, self.first, mask)
            used = item[np.searchsorted(self.first, at, "right") - 1]
            at, keys = at[used], keys[used]
            order = np.argsort(keys, kind="stable")
            if len(order):
                seen = np.zeros(1 << 22, bool)
                seen[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
                self.tables.append((mask, keys[order], at[order], np.packbits(seen)))

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Place in the documents and place in the items of each pair of equal seeds, in parts."""
        for mask, keys, places, seen in self.tables:
            at, found = seeds(words, first, mask)
            low = (found & np.uint64((1 << 22) - 1)).astype(np.int64)
            maybe = np.flatnonzero(seen[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            at, found = at[maybe], found[maybe]
            left = np.searchsorted(keys, found, "left")
            n = np.searchsorted(keys, found, "right") - left
            at, left, n = at[n > 0], left[n > 0], n[n > 0]
            for low, high in pieces(np.concatenate([[0], np.cumsum(n)]), PART):
                yield np.repeat(at[low:high], n[low:high]), places[ragged(left[low:high], n[low:high])]

    def leaks(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(text, item): the overlap with the most equal words, for texts that leak an item."""
        found: dict[tuple[int, int], tuple] = {}
        for mine, theirs in self.hits(words, first):
            text = np.searchsorted(first, mine, "right") - 1
            item = np.searchsorted(self.first, theirs, "right") - 1
            shift = mine - theirs
            order = np.lexsort((shift, item, text))
            text, item, shift = text[order], item[order], shift[order]
            new = np.ones(len(order), bool)
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
            text, item, shift = text[new], item[new], shift[new]
            low = np.maximum(self.first[item], first[text] - shift)
            size = np.minimum(self.first[item + 1], first[text + 1] - shift) - low
            long = size >= self.least[item]
            text, item, shift, low, size = text[long], item[long], shift[long], low[long], size[long]
            for begin, end in pieces(np.concatenate([[0], np.cumsum(size)]), PART):
                part = slice(begin, end)
                at = ragged(low[part], size[part])
                equal = self.words[at] == words[at + np.repeat(shift[part], size[part])]
                ends = np.cumsum(size[part])
                n_equal = np.add.reduceat(equal, ends - size[part], dtype=np.int64)
                for j in np.flatnonzero(n_equal >= self.least[item[part]]).tolist():
                    t, i, s, w = int(text[begin + j]), int(item[begin + j]), int(shift[begin + j]), int(low[begin + j])
                    own = equal[ends[j] - size[begin + j] : ends[j]]
                    a, b = longest_overlap(own)
                    n = int(own[a:b].sum())
                    if n >= self.least[i]:
                        row = (n, a - b, -(w + s + a - int(first[t])), w + a - int(self.first[i]))
                        found[t, i] = max(found.get((t, i), row), row)
        return found


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each start, the n numbers from it on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def longest_overlap(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch of which the least share is equal, without the unequal words at its ends.

    If any such stretch has enough equal words, this one has: the other can be widened until its
    share is used up, and is no longer then.
    """
    sums = np.concatenate([[0], np.cumsum(equal - LEAST_SHARE)])
    later = np.maximum.accumulate(sums[::-1])[::-1]
    end = np.searchsorted(-later, -sums, "right") - 1
    start = int(np.argmax(end - np.arange(len(sums))))
    inside = start + np.flatnonzero(equal[start : end[start]])
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (start, start)


def _leaks(block: Block):
    kinds = [pa.int64()] * 6
    names = [c.split()[0] for c in LEAK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = buffer_of(batch.column("text"))
            rows = []
            for low, high in pieces(offsets):
                words, first = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for (t, i), (n_equal, size, start, place) in sorted(block.leaks(words, first).items()):
                    rows.append((ids[low + t].as_py(), int(block.item_ids[i]), -start, place, -size, n_equal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; a partition at a time comes to the driver."""
    ids, texts, size = [], [], 0
    rows = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")
    )
    for row in rows.toLocalIterator():
        text = row.t.encode()
        if texts and size + len(text) > block_bytes:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(text)
        size += len(text)
    if texts:
        yield Block(ids, texts)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_equal: the best overlap of each pair that leaks.

    A pair leaks if along one alignment a stretch has 13 equal words (three quarters of the item's,
    if that is less) and three quarters of its words are equal; all such pairs are found. Items of 1
    to 4 words leak where all of them stand in a row. Null items, items without words and null texts never match. A benchmark of any size is taken in blocks of `block_bytes`, each with one narrow scan of
    the documents and no shuffle. Repeated rows are reported each on their own; empty tables give no
    rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [rows.mapInArrow(_leaks(block), LEAK) for block in blocks(benchmark, item_id_col, item_text_col, block_bytes)]
    out = found[0] if found else docs.sparkSession.createDataFrame([], LEAK)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _clean(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            keep = np.ones(len(offsets) - 1, bool)
            for low, high in pieces(offsets):
                words, first = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for t, _ in block.leaks(words, first):
                    keep[low + t] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns; see `find_leaks`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col(text_col).cast("string").alias("text"))
    for block in blocks(benchmark, "item_id", "text", block_bytes):
        rows = rows.mapInArrow(_clean(block), rows.schema)
    return rows.select("kept.*")
