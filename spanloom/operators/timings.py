"""Clock skew correction over traces of any size, by pointer jumping.

Each round doubles how far up every span has looked, so a chain of a billion spans takes 30
rounds of one equi-join on (trace, span id). Each round's result is written as a table: the
plan stays one join deep, and a lost executor costs one round's tasks, not the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.clocks import has_all_timings, skew
from spanloom.functions.numbers import add, subtract
from spanloom.schema import FIRST_PLAUSIBLE_NS, TIMINGS, TRACE, cut_lineage, work_dir

_KEYS = [*TRACE, "span_id"]


def _target(df: DataFrame, *columns: str) -> DataFrame:
    """df as the right side of a jump along `ptr`."""
    return df.select(
        *TRACE, F.col("span_id").alias("ptr"), *[F.col(c).alias(f"up_{c}") for c in columns]
    )


def correct_timings(spans: DataFrame, base_offset_ns: int = 0) -> DataFrame:
    """Corrected start and duration; needs traces with a unique root.

    A span starts later by the summed skew of its strict ancestors. With all four timings
    known it starts at its client send time instead, plus that sum, and lasts until client
    receive. A start before 2020 then gives way to the parent's final start. Spans in or
    below a cycle keep what they have.
    """
    folder = work_dir(spans.sparkSession)
    timings = [F.col(c) for c in TIMINGS]
    spans = cut_lineage(spans, f"{folder}/spans")
    # What is joined round by round are ids and sums; times come in once the sums are known.
    own = spans.select(*_KEYS, "parent_id", skew(*timings).alias("skew"))
    ptr = F.when(F.col("parent_id") != F.col("span_id"), F.col("parent_id"))
    # First jump: a parent that is not there makes the span the root.
    nodes = (
        own.select(*_KEYS, ptr.alias("ptr"))
        .join(_target(own, "skew", "span_id"), [*TRACE, "ptr"], "left")
        .select(
            *_KEYS, F.col("up_span_id").alias("ptr"), F.coalesce("up_skew", F.lit(0)).alias("sum"),
            F.col("up_span_id").alias("parent"),
        )
    )
    jumps = cut_lineage(nodes, f"{folder}/linked")
    open_before, round_no = None, 0
    # A chain shortens every round; when nothing does, only cycles are left.
    while (still := jumps.filter(F.col("ptr").isNotNull()).count()) not in (0, open_before):
        open_before, round_no = still, round_no + 1
        jumped = jumps.join(_target(jumps, "ptr", "sum"), [*TRACE, "ptr"], "left").select(
            *_KEYS,
            F.col("up_ptr").alias("ptr"),
            add(F.col("sum"), F.coalesce("up_sum", F.lit(0).cast("bigint"))).alias("sum"),
            "parent",
        )
        jumps = cut_lineage(jumped, f"{folder}/jump={round_no}")

    found = jumps.filter(F.col("ptr").isNull()).select(*_KEYS, "sum", "parent")
    shifted = add(F.col("sum"), F.lit(base_offset_ns).cast("bigint"))
    known = has_all_timings(*timings)
    start = F.when(known, add(F.col("cs"), shifted)).otherwise(add(F.col("start_ns"), shifted))
    length = F.when(known, subtract(F.col("cr"), F.col("cs"))).otherwise(F.col("duration_ns"))
    reached = F.col("sum").isNotNull()
    timed = (
        spans.select(*_KEYS, "start_ns", "duration_ns", *TIMINGS)
        .join(found, _KEYS, "left")
        .select(
            *_KEYS,
            F.when(reached, start).otherwise(F.col("start_ns")).alias("start_ns"),
            F.when(reached, length).otherwise(F.col("duration_ns")).alias("duration_ns"),
            # Where to take the start from, null once it is final.
            F.when(reached & (start < FIRST_PLAUSIBLE_NS), F.col("parent")).alias("ptr"),
        )
    )
    timed = cut_lineage(timed, f"{folder}/timed")
    repairs = timed.select(*_KEYS, "start_ns", "ptr")
    round_no = 0
    while repairs.filter(F.col("ptr").isNotNull()).count():
        round_no += 1
        moved = repairs.join(_target(repairs, "start_ns", "ptr"), [*TRACE, "ptr"], "left").select(
            *_KEYS,
            F.when(F.col("ptr").isNull(), F.col("start_ns"))
            .otherwise(F.col("up_start_ns"))
            .alias("start_ns"),
            F.col("up_ptr").alias("ptr"),
        )
        repairs = cut_lineage(moved, f"{folder}/repair={round_no}")
    final = repairs.select(*_KEYS, "start_ns").join(
        timed.select(*_KEYS, "duration_ns"), _KEYS
    )
    return spans.drop("start_ns", "duration_ns").join(final, _KEYS).select(*spans.columns)
