"""Trace trees as joins on (trace, span id).

These work on merged spans of traces of any size: every join spreads a trace over all tasks
by span id. For traces of bounded size operators/traces.py does roots and timings in one go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.numbers import add, subtract
from spanloom.schema import FAKE_ROOT, TIMINGS, TRACE, cut_lineage


def _parent_keys(spans: DataFrame) -> DataFrame:
    """(trace, id) of every span, under the name a child knows it by."""
    return spans.select(*TRACE, F.col("span_id").alias("parent_id"))


def roots(spans: DataFrame) -> DataFrame:
    """Root candidates: spans that are their own parent, or whose parent is not there."""
    own = spans.filter(F.col("parent_id") == F.col("span_id"))
    others = spans.filter(F.col("parent_id") != F.col("span_id"))
    return own.unionByName(others.join(_parent_keys(spans), [*TRACE, "parent_id"], "left_anti"))


def children(spans: DataFrame) -> DataFrame:
    """Spans whose parent is there, with the parent's name and service; no self-parents."""
    parents = spans.select(
        *TRACE, F.col("span_id").alias("parent_id"),
        F.col("name").alias("parent_name"), F.col("service").alias("parent_service"),
    )
    others = spans.filter(F.col("parent_id") != F.col("span_id"))
    return others.join(parents, [*TRACE, "parent_id"])


def by_parent(spans: DataFrame) -> DataFrame:
    """One row per parent id and span below it, self-parents included, with the parent's count.

    The counts combine before their shuffle, and are one row per parent in the join, so a parent
    with very many spans can be split.
    """
    keys = [*TRACE, "parent_id"]
    counts = spans.groupBy(*keys).agg(F.count("*").alias("n"))
    return spans.select(*keys, "span_id").join(counts, keys)


def storage_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*TRACE, F.desc("span_id"))


def get_span(spans: DataFrame, trace_id: int, span_id: int) -> DataFrame:
    return spans.filter((F.col("trace_id") == trace_id) & (F.col("span_id") == span_id))


def has_span(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (trace, span id) plus whether that span exists."""
    keys = [*TRACE, "span_id"]
    present = spans.select(*keys).distinct().withColumn("present", F.lit(True))
    return wanted.join(present, keys, "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def trace_root(spans: DataFrame) -> DataFrame:
    """The span whose id is the trace id, where there is one."""
    return spans.filter(F.col("span_id") == F.col("trace_id"))


def same_parent(candidates: DataFrame) -> DataFrame:
    """Per trace: number of root candidates and whether they all name one parent."""
    return candidates.groupBy(*TRACE).agg(
        F.count("*").alias("candidates"),
        (F.min("parent_id") == F.max("parent_id")).alias("same_parent"),
        F.min("parent_id").alias("parent_id"),
    )


def fake_roots(spans: DataFrame) -> DataFrame:
    """The span to invent for each trace whose several candidates share a parent."""
    end = add(F.col("start_ns"), F.col("duration_ns"))
    groups = roots(spans).groupBy(*TRACE).agg(
        F.count("*").alias("candidates"),
        F.min("parent_id").alias("low"),
        F.max("parent_id").alias("high"),
        F.min("start_ns").alias("start_ns"),
        F.max(end).alias("end_ns"),
        F.max("last_at").alias("last_at"),
    )
    zero = F.lit(0).cast("bigint")
    return groups.filter((F.col("candidates") > 1) & (F.col("low") == F.col("high"))).select(
        *TRACE,
        F.col("low").alias("span_id"),
        F.col("trace_id").alias("parent_id"),
        F.lit(FAKE_ROOT).alias("name"),
        F.lit(FAKE_ROOT).alias("service"),
        "start_ns",
        subtract(F.col("end_ns"), F.col("start_ns")).alias("duration_ns"),
        *[zero.alias(c) for c in TIMINGS],
        F.create_map().cast("map<string,string>").alias("tags"),
        F.col("last_at").alias("received_at"), zero.alias("payload_id"), zero.alias("pos"),
        "last_at", zero.alias("reports"),
    )


def inject_fake_root(spans: DataFrame, path: str | None = None) -> DataFrame:
    """The spans and their fake roots, which are written once at `path` if one is given."""
    fakes = fake_roots(spans).select(*spans.columns)
    return spans.unionByName(cut_lineage(fakes, path) if path else fakes)


def require_unique_root(spans: DataFrame) -> DataFrame:
    """Spans of the traces with exactly one root candidate."""
    unique = same_parent(roots(spans)).filter(F.col("candidates") == 1)
    return spans.join(unique.select(*TRACE), TRACE, "left_semi")


def trace_outline(spans: DataFrame, max_level: int = 6, max_children: int = 32) -> DataFrame:
    """Depth-first listing of every trace, one row per line; `path` sorts a trace's lines.

    Below `max_level` and after `max_children` children a line says what was cut. Children
    come by span id, highest first. The rank filter is cut down per task before the shuffle,
    so a parent with very many children costs `max_children` rows per task.
    """
    parent = [*TRACE, "parent_id"]
    line = ["span_id", "name", "start_ns", "duration_ns"]
    linked = spans.filter(F.col("parent_id") != F.col("span_id"))
    rank = F.row_number().over(W.partitionBy(*parent).orderBy(F.desc("span_id")))
    counts = linked.groupBy(*parent).agg(F.count("*").alias("n"))
    shown = (
        linked.select(*parent, *line)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= max_children)
    )
    kids = shown.select(
        *TRACE, F.col("parent_id").alias("up"), "rank",
        *[F.col(c).alias(f"kid_{c}") for c in line],
    )
    counts = counts.withColumnRenamed("parent_id", "span_id")

    def path_part(c: Column) -> Column:
        # Ids order highest first: flip them, then compare as fixed-width hex.
        return F.lpad(F.hex(F.bitwise_not(c).bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0")

    level = (
        roots(spans)
        .join(counts, [*TRACE, "span_id"], "left")
        .select(
            *TRACE, *line, "parent_id", F.lit(0).alias("level"),
            path_part(F.col("span_id")).alias("path"), F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
    levels = [level]
    for depth in range(1, max_level + 1):
        above = levels[-1].filter(F.col("n") > 0).select(
            *TRACE, F.col("span_id").alias("up"), "path"
        )
        found = above.join(kids, [*TRACE, "up"]).select(
            *TRACE, *[F.col(f"kid_{c}").alias(c) for c in line],
            F.col("up").alias("parent_id"), F.lit(depth).alias("level"),
            F.concat("path", F.lit("/"), F.lpad("rank", 10, "0")).alias("path"),
        )
        levels.append(
            found.join(counts, [*TRACE, "span_id"], "left").withColumn(
                "n", F.coalesce("n", F.lit(0))
            )
        )
    listed = reduce(DataFrame.unionByName, levels)
    marker = (
        F.when((F.col("level") == max_level) & (F.col("n") > 0), F.lit("[...]"))
        .when(
            F.col("n") > max_children,
            F.concat(F.lit("[... "), (F.col("n") - max_children), F.lit(" more children]")),
        )
    )
    cut = listed.withColumn("marker", marker).filter(F.col("marker").isNotNull()).select(
        *TRACE, (F.col("level") + 1).alias("level"), F.concat("path", F.lit("/~")).alias("path"),
        F.col("marker").alias("text"), F.col("span_id").alias("parent_id"),
        F.lit(0).cast("bigint").alias("span_id"),
    )
    text = F.concat(
        "name", F.lit(" ["), F.lpad(F.lower(F.hex("span_id")), 16, "0"), F.lit("]")
    )
    return listed.select(
        *TRACE, "level", "path", text.alias("text"), "parent_id", "span_id"
    ).unionByName(cut)
