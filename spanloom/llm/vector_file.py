"""Exact top-k search by inner product with a vector-approximation file.

Each component of a vector is quantised to one of 64 cells per dimension, cut at quantiles of all
rows. The file of cells, a byte per component, is scanned in two passes: the first takes the kth
largest lower bound of each query, the second all vectors whose upper bound reaches it. Their exact
vectors are read in descending order of the upper bound (a query's distance order, as inner
products stand for distances): first twice k of them, then, as long as an upper bound reaches the
kth exact score, the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Steps
from spanloom.llm.vectors import dealt, integer_vector, matrix, meet

CELLS = 64  # of each dimension
PART = 4096  # vectors of the file that a call scans
BLOCK = 1024  # queries that scan together
CHUNK = 128  # queries whose bounds are held at a time

LOWS = "q bigint, low double"
PAIRS = "q bigint, c bigint, upper double"
RANKED = "query_id bigint, rank int, vec_id bigint, score bigint"


def marks_of(classes: DataFrame, cells: int = CELLS) -> list[np.ndarray]:
    """For each dimension, the least integer of each of its cells, and behind them the largest plus 1.

    One row per dimension comes to the driver.
    """
    at = [i / cells for i in range(1, cells)]
    rows = classes.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", at, 1000).alias("cuts")
    ).orderBy("dim").collect()
    return [np.unique([min(r.low, 0), *r.cuts, r.low, max(r.high, 0) + 1]) for r in rows]


def _cells(marks: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), len(marks))
            cells = np.empty(v.shape, np.uint8)
            for i, own in enumerate(marks):
                cells[:, i] = np.searchsorted(own, v[:, i], "right") - 1
            texts = pa.array([row.tobytes() for row in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("copies"), texts], names=["c", "copies", "cells"])

    return run


class Bounds:
    """Lower and upper bounds of the inner products of queries with quantised vectors."""

    def __init__(self, marks: list[np.ndarray]):
        self.mid, self.half = np.zeros((2, len(marks), 256))
        for i, own in enumerate(marks):
            low, high = own[:-1].astype(float), own[1:].astype(float) - 1
            self.mid[i, : len(low)], self.half[i, : len(low)] = (low + high) / 2, (high - low) / 2

    def scan(self, file: pa.Table, queries: pa.Table) -> Iterator[tuple]:
        """For some queries at a time: their rows, and the bounds as queries by vectors.

        The entry of a vector that only the query itself has is minus infinity.
        """
        dim = len(self.mid)
        cells = np.frombuffer(b"".join(file.column("cells").to_pylist()), np.uint8).reshape(file.num_rows, dim)
        mid = np.take_along_axis(self.mid.T, cells.astype(np.intp), 0)
        half = np.take_along_axis(self.half.T, cells.astype(np.intp), 0)
        c, copies = file.column("c").to_numpy(), file.column("copies").to_numpy()
        for low in range(0, queries.num_rows, CHUNK):
            part = queries.slice(low, CHUNK)
            v = matrix(part.column("v"), dim).astype(float)
            middle, reach = v @ mid.T, np.abs(v) @ half.T
            alone = (part.column("c").to_numpy()[:, None] == c[None, :]) & (copies == 1)[None, :]
            middle[alone] = -np.inf
            yield part, c, middle - reach, middle + reach


def _lows(marks: list[np.ndarray], k: int):
    def run(file: pa.Table, queries: pa.Table) -> pa.Table:
        q, lows = [np.empty(0, np.int64)], [np.empty(0)]
        if file.num_rows and queries.num_rows:
            for part, _, low, _ in Bounds(marks).scan(file, queries):
                n = min(k, low.shape[1])
                best = -np.partition(-low, n - 1, axis=1)[:, :n]
                q.append(np.repeat(part.column("q").to_numpy(), n))
                lows.append(best.ravel())
        q, lows = np.concatenate(q), np.concatenate(lows)
        return pa.table({"q": q[lows > -np.inf], "low": lows[lows > -np.inf]})

    return run


def _pairs(marks: list[np.ndarray]):
    def run(file: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if file.num_rows and queries.num_rows:
            for part, c, _, upper in Bounds(marks).scan(file, queries):
                least = part.column("least").to_numpy()
                row, column = np.nonzero((upper >= least[:, None]) & (upper > -np.inf))
                found.append((part.column("q").to_numpy()[row], c[column], upper[row, column]))
        return pa.table(dict(zip(("q", "c", "upper"), (np.concatenate(x) for x in zip(*found)))))

    return run


def _scores(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column("v"), dim), matrix(batch.column("w"), dim)
            score = np.einsum("ij,ij->i", a, b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("own"), batch.column("c"), batch.column("ids"), pa.array(score)],
                names=["q", "own", "c", "ids", "score"],
            )

    return run


def top_inner(
    df: DataFrame, is_query: Column, k: int = 20, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding",
    part: int = PART, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows with the largest inner products.

    Components become floor(scale * x). Queries are the rows for which `is_query` holds; every row
    but the query's own is a candidate. Ties go to the smaller id. Rows with a null id, a null
    vector, or null or non-finite components take no part. Shorter vectors go on with zeros.
    Repeated rows count once; a row that repeats an id with another vector is a row of its own.
    Scores are exact where they and their sums fit 53 bits. Fewer than k rows are all returned; an
    empty table gives no rows; other columns are not read.

    Of rows with equal vectors only the k + 1 with the smallest ids can be among the first k, so
    a vector that very many rows share is one candidate with that many ids. What grows with the input
    is dealt by hash, a part of the file and a block of queries to a call.
    """
    steps = Steps(df.sparkSession)
    rows = steps.write(
        df.select(F.col(id_col).cast("bigint").alias("id"), integer_vector(F.col(vec_col), scale).alias("v"), is_query.alias("asks"))
        .filter("id is not null and v is not null").groupBy("id", "v").agg(F.max("asks").alias("asks")), "vectors",
    )
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    shared = rows.select("id", "v").withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = shared.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = steps.write(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("copies", F.size("ids")), "classes")
    asking = rows.filter("asks").select("id", "v").join(classes.select("v", "c"), "v")
    queries = steps.write(asking.select(F.monotonically_increasing_id().alias("q"), "id", "c", "v"), "queries")
    n, n_queries = classes.count(), queries.count()
    if not n or not n_queries:
        return df.sparkSession.createDataFrame([], RANKED)
    marks = marks_of(classes)
    parts, blocks = -(-n // part), -(-n_queries // block)

    file = classes.select("c", "copies", "v").mapInArrow(_cells(marks), "c bigint, copies int, cells binary")
    file = steps.write(file.withColumn("part", dealt(F.col("c"), parts)), "file")
    asked = queries.select("q", "c", "v", dealt(F.col("q"), blocks).alias("block"))
    lows = meet(file, asked, parts, blocks, _lows(marks, k), LOWS)
    order = Window.partitionBy("q").orderBy(F.desc("low"))
    kth = lows.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k)
    bounded = steps.write(asked.join(kth.select("q", F.col("low").alias("least")), "q", "left").fillna(float("-inf"), "least"), "bounded")
    pairs = meet(file, bounded, parts, blocks, _pairs(marks), PAIRS)
    order = Window.partitionBy("q").orderBy(F.desc("upper"), "c")
    pairs = steps.write(pairs.withColumn("place", F.row_number().over(order)), "pairs")

    def exact(some: DataFrame) -> DataFrame:
        both = some.select("q", "c").join(classes.select("c", "ids", "v"), "c").join(
            queries.select("q", F.struct("id", F.col("c").alias("c")).alias("own"), F.col("v").alias("w")), "q"
        )
        scored = both.select("q", "own", "c", "ids", "v", "w").mapInArrow(
            _scores(len(marks)), "q bigint, own struct<id: bigint, c: bigint>, c bigint, ids array<bigint>, score bigint"
        )
        each = scored.select("q", F.col("own.id").alias("query_id"), "c", F.col("own.c").alias("own_c"), F.explode("ids").alias("vec_id"), "score")
        return each.filter("not (c = own_c and vec_id = query_id)").select("q", "query_id", "vec_id", "score")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    first = steps.write(exact(pairs.filter(F.col("place") <= 2 * k)), "first-read")
    kth = first.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k)
    late = pairs.filter(F.col("place") > 2 * k).join(kth.select("q", "score"), "q").filter("upper >= score")
    scored = first.unionByName(exact(late)).withColumn("rank", F.row_number().over(best))
    return scored.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
