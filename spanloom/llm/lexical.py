"""Ranked lexical search of a batch of items over all documents, with hashed max-sketches.

A document's sketch is an array of coordinates, some times as many as it has distinct terms. Each
term's impact (its weight by the saturation of its count) is folded into the coordinate of the
term's hash by the maximum, so the coordinate of any term bounds its impact from above. For a batch
of items the coordinates of all their terms are looked up at once; their sum bounds an item's score
of the document. Along a partition, documents are rescored exactly in descending order of the bound
until it is below the tenth best exact score so far.

The weight of a term needs the number of documents that hold it. For the sketches it is taken from
a table of the largest weight among the terms of each of 2 ** 20 hash buckets, so what tasks hold does not grow with the
number of terms; the items' own terms have exact weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Steps
from spanloom.llm.tokens import buffer_of, pieces, word_hashes

FIRST = 10  # documents of an item
BUCKETS = 1 << 20  # of the table of weights
ROOM = 64  # coordinates for each distinct term of a document, rounded up to a power of two
BLOCK_BYTES = 1 << 20  # of items that one scan of the documents looks up
TILE = 64  # documents that are bounded together
LONG = np.int64

COUNTED = "term bigint, df bigint"
TOTALS = "n bigint, length bigint"
BEST = "item bigint, doc_id bigint, score bigint"


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each text, its distinct terms (sorted hashes) with their counts, and its length in terms.

    A long text is hashed in one go; several short ones together.
    """
    data, offsets = buffer_of(column)
    for low, high in pieces(offsets):
        words, first = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        for i in range(high - low):
            own = words[first[i] : first[i + 1]]
            terms, counts = np.unique(own, return_counts=True)
            yield terms, counts, len(own)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a batch hold each term; the null term is for lengths: documents with terms."""
    for batch in batches:
        found, total, some = [np.empty(0, np.uint64)], 0, 0
        for terms, _, length in terms_of(batch.column("text")):
            found.append(terms)
            total, some = total + length, some + (length > 0)
        terms, df = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(LONG)), pa.array(df)], names=["term", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([some << 1, total << 1 | 1], pa.int64())], names=["term", "df"])


@dataclass
class Corpus:
    """Counts of all documents: n with terms, their length in terms, and weights."""

    n: int
    length: int
    weights: np.ndarray  # the largest of each hash bucket
    counts: DataFrame  # term, df

    def slower(self, length: np.ndarray) -> np.ndarray:
        """What a document's length makes of its counts, in percent."""
        return 100 - 90 + (90 * length * self.n) // self.length


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(LONG)


def impacts(weights: np.ndarray, counts: np.ndarray, slower) -> np.ndarray:
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * slower))


def count_corpus(docs: DataFrame, steps: Steps) -> Corpus:
    """Two counts of all documents: how many hold each term, combined before the shuffle, and the totals."""
    counted = steps.write(docs.mapInArrow(_counted, COUNTED), "term-counts")
    half = F.col("df").bitwiseAND(1)
    totals = counted.filter("term is null").select((F.col("df") / 2).cast("bigint").alias("x"), half.alias("kind"))
    sums = {r.kind: r.s for r in totals.groupBy("kind").agg(F.sum("x").alias("s")).collect()}
    counts = counted.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    counts = steps.write(counts, "document-frequencies")
    bucket = F.pmod(F.col("term"), F.lit(BUCKETS)).cast("int")
    least = counts.groupBy(bucket.alias("b")).agg(F.min("df").alias("df")).toArrow()
    n = sums.get(0, 0)
    weights = np.zeros(BUCKETS, np.int32)
    weights[least.column("b").to_numpy()] = weight(n, least.column("df").to_numpy())
    return Corpus(n, sums.get(1, 0), weights, counts)


@dataclass
class Batch:
    """Items by number, with their distinct terms; the terms of all items, and weights."""

    first: np.ndarray  # of each item in `place`, n + 1
    place: np.ndarray  # in `terms`, item by item
    terms: np.ndarray  # sorted
    weights: np.ndarray


def sketch(terms: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """The largest impact of each coordinate; a power of two of them."""
    size = 1 << max(6, int(len(terms) * ROOM - 1).bit_length())
    out = np.zeros(size, LONG)
    np.maximum.at(out, (terms & np.uint64(size - 1)).astype(LONG), impact)
    return out


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each start, the n numbers from it on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Search:
    """The best documents of each item so far, over the documents shown."""

    def __init__(self, batch: Batch, corpus_weights: np.ndarray, n: int, length: int, first: int):
        self.batch, self.most, self.first = batch, corpus_weights, first
        self.slower = Corpus(n, length, corpus_weights, None).slower
        items = len(batch.first) - 1
        self.least = np.zeros(items, LONG)  # the last of the first scores, once there are so many
        self.best: list[list[tuple[int, int | None]]] = [[] for _ in range(items)]  # score and document

    def looked_up(self, terms: np.ndarray, counts: np.ndarray, slow: int) -> np.ndarray:
        """For each term of the items, the most that its impact in a document can be, from the sketch."""
        weights = self.most[(terms & np.uint64(BUCKETS - 1)).astype(LONG)].astype(LONG)
        folded = sketch(terms, impacts(weights, counts.astype(LONG), slow))
        found = folded[(self.batch.terms & np.uint64(len(folded) - 1)).astype(LONG)]
        return np.minimum(found, impacts(self.batch.weights, int(counts.max()), slow))

    def exact(self, tile: list[tuple], slow: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The score of each pair of a document of the tile and an item."""
        rows, at = np.unique(row, return_inverse=True)
        impact = np.zeros((len(rows), len(self.batch.terms)), LONG)
        for i, r in enumerate(rows.tolist()):
            _, terms, counts, _ = tile[r]
            place = np.minimum(np.searchsorted(self.batch.terms, terms), len(self.batch.terms) - 1)
            hit = self.batch.terms[place] == terms
            impact[i, place[hit]] = impacts(self.batch.weights[place[hit]], counts[hit].astype(LONG), slow[r])
        n = np.diff(self.batch.first)[item]
        parts = impact[np.repeat(at, n), self.batch.place[ragged(self.batch.first[item], n)]]
        return np.add.reduceat(parts, np.cumsum(n) - n)

    def show(self, tile: list[tuple[int | None, np.ndarray, np.ndarray, int]]) -> None:
        """Bound some documents for all items, then rescore: for each item the document with the
        largest bound, then all whose bounds reach the item's last of the first scores."""
        slow = self.slower(np.array([length for *_, length in tile], LONG))
        looked = np.stack([self.looked_up(terms, counts, s) for (_, terms, counts, _), s in zip(tile, slow.tolist())])
        bounds = np.add.reduceat(looked[:, self.batch.place], self.batch.first[:-1], axis=1)
        items = np.arange(bounds.shape[1])
        highest = bounds.argmax(axis=0)
        done = np.zeros(bounds.shape, bool)
        done[highest, items] = True
        for among in (done, ~done):
            row, item = np.nonzero(among & (bounds > 0) & (bounds >= self.least))
            if not len(row):
                continue
            score = self.exact(tile, slow, row, item)
            for j in np.flatnonzero((score > 0) & (score >= self.least[item])).tolist():
                self.keep(int(item[j]), int(score[j]), tile[row[j]][0])

    def keep(self, item: int, score: int, doc: int | None) -> None:
        best = self.best[item]
        best.append((score, doc))
        if len(best) >= self.first:
            best.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            del best[self.first :]
            self.least[item] = best[-1][0]


def _searched(batch: Batch, weights: np.ndarray, n: int, length: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, tile = Search(batch, weights, n, length, first), []
        for rows in batches:
            for doc, (terms, counts, size) in zip(rows.column("doc_id").to_pylist(), terms_of(rows.column("text"))):
                if size:
                    tile.append((doc, terms, counts, size))
                if len(tile) == TILE:
                    search.show(tile)
                    tile = []
        if tile:
            search.show(tile)
        found = [(item, doc, score) for item, best in enumerate(search.best) for score, doc in best]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item", "doc_id", "score"])

    return run


def batches_of(items: DataFrame, corpus: Corpus, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Batch, list]]:
    """Items in blocks of bounded size, with the ids of their rows; a partition at a time comes to the driver."""
    spark = items.sparkSession
    ids, texts, size = [], [], 0

    def block() -> Batch:
        words, first = word_hashes(*buffer_of(pa.array(texts, pa.string())))
        own = [np.unique(words[first[i] : first[i + 1]]) for i in range(len(texts))]
        terms = np.unique(np.concatenate(own))
        wanted = spark.createDataFrame(pa.table({"term": terms.view(LONG)}))
        known = corpus.counts.join(F.broadcast(wanted), "term").toArrow()
        df = np.zeros(len(terms), LONG)
        df[np.searchsorted(terms, known.column("term").to_numpy().view(np.uint64))] = known.column("df").to_numpy()
        return Batch(
            np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.searchsorted(terms, np.concatenate(own)), terms, weight(corpus.n, df),
        )

    for row in items.toLocalIterator():
        bytes_ = len(row.text.encode())
        if texts and size + bytes_ > block_bytes:
            yield block(), ids
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += bytes_
    if texts:
        yield block(), ids


def search(
    docs: DataFrame, items: DataFrame, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `first` documents of each item with the highest scores above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. A
    text that is null or has no term is no document, and an item without terms finds nothing.
    Scores are 64-bit integers; ties go to the smaller doc_id, null last. Repeated rows of `docs` are
    documents on their own; repeated rows of `items` count once, and an item id with two texts is
    two items. Empty tables give no rows; other columns are not read. Terms are told by 64-bit hashes.

    The documents are scanned once for their counts and once for each block of items; no text is
    shuffled. A task gives out at most `first` documents for each item.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = asked.filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")).distinct()
    out = spark.createDataFrame([], asked.select("item_id").schema).selectExpr(
        "item_id", "cast(0 as int) as rank", "cast(0 as bigint) as doc_id", "cast(0 as bigint) as score"
    )
    corpus = count_corpus(rows.select("text"), steps)
    if not corpus.n:
        return out
    for batch, ids in batches_of(asked, corpus, block_bytes):
        found = rows.mapInArrow(_searched(batch, corpus.weights, corpus.n, corpus.length, first), BEST)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {asked.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
