"""Length buckets with least padding, and token-budget batches inside each bucket.

One histogram of lengths over all documents (at most `max_tokens + 1` counts) goes to the driver.
Dynamic programming over it finds the bucket bounds with the least padding. Texts stay where
they are; only ids and lengths are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS = 4096
BUCKETS = 16
BUDGET = 65_536
LANE_ROWS = 16_384

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def count_tokens(text: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN)).cast("bigint")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most `buckets` upper bounds over sorted distinct lengths, with the least total padding.

    cost[k][j], the least sum of bounds over the first j lengths in k buckets, is the least of
    cost[k - 1][i] + length[j] * rows(i to j) over all i. Ties go to the larger first part.
    """
    if not lengths:
        return []
    size = np.array(lengths, np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64))])
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        after, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j])
            cut[j] = j - 1 - int(np.argmin(cost[::-1]))
            after[j] = cost[cut[j]]
        cuts.append(cut)
        best = after
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(lengths[j - 1])
        j = cut[j]
    return bounds[::-1]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
    max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """doc_id, piece, n_tokens, bucket, lane, batch, slot, padding: one row per sequence.

    A document of over `max_tokens` tokens becomes consecutive pieces; others are one piece, also
    when null or empty (0 tokens). `bucket` is the padded length; `(bucket, lane, batch)` is a
    batch, with at most `budget` padded tokens (one sequence if that alone is longer). A bucket is
    dealt by hash to lanes of about `lane_rows` sequences, so a bucket that holds most rows fills
    many tasks; a lane's last batch may be short. Rows that repeat a doc_id are packed each on
    their own; a null doc_id is kept. An empty table gives no rows. Other columns are not read.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), (count_tokens(F.col(text_col)) if tokens is None else tokens).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_tokens).cast("bigint"), F.lit(1).cast("bigint")) - 1
    sequences = counted.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(max_tokens).cast("bigint"), F.col("total") - F.col("piece") * max_tokens).alias("n_tokens")
    )
    histogram = sorted((r.n_tokens, r["count"]) for r in sequences.groupBy("n_tokens").count().collect())
    bounds = best_bounds([n for n, _ in histogram], [c for _, c in histogram], buckets)
    if not bounds:
        bounds = [0]
    held = dict.fromkeys(bounds, 0)
    for n, c in histogram:
        held[min(b for b in bounds if b >= n)] += c
    bucket, lanes, per_batch = F.lit(bounds[-1]), F.lit(1), F.lit(1)
    for b in reversed(bounds):
        fits = F.col("n_tokens") <= b
        bucket = F.when(fits, b).otherwise(bucket)
        lanes = F.when(fits, max(1, -(-held[b] // lane_rows))).otherwise(lanes)
        per_batch = F.when(fits, max(1, budget // max(b, 1))).otherwise(per_batch)
    dealt = sequences.select(
        "*", bucket.cast("bigint").alias("bucket"),
        F.pmod(F.xxhash64("doc_id", "piece"), lanes.cast("bigint")).alias("lane"),
        per_batch.cast("bigint").alias("per_batch"),
    )
    place = F.row_number().over(Window.partitionBy("bucket", "lane").orderBy("doc_id", "piece", "n_tokens")).cast("bigint") - 1
    return dealt.withColumn("place", place).select(
        "doc_id", "piece", "n_tokens", "bucket", "lane",
        F.floor(F.col("place") / F.col("per_batch")).alias("batch"),
        (F.col("place") % F.col("per_batch")).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
