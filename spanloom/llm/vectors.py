"""Integer vectors, and meetings of bounded parts of candidates with bounded blocks of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import shuffle_partitions


def integer_vector(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long; null unless all components are finite numbers."""
    real = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(real, lambda x: F.floor(x * F.lit(float(scale)))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of longs; shorter vectors go on with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def dealt(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def meet(
    candidates: DataFrame, queries: DataFrame, parts: int, blocks: int,
    fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
) -> DataFrame:
    """Calls `fn` with each part of the candidates and each block of the queries.

    Candidates have a column `part`, queries a column `block`; their sizes are bounded by the caller,
    so a call holds two bounded tables, and no more is sent than one copy of a part for each block
    and of a block for each part.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    n = shuffle_partitions(candidates.sparkSession)
    left = candidates.withColumn("block", spread(blocks)).repartition(n, "part", "block")
    right = queries.withColumn("part", spread(parts)).repartition(n, "part", "block")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(fn, schema)
