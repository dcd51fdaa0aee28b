"""Cutting a trace id's arrivals into traces and judging them.

Arrivals less than a gap apart belong together, so all arrivals of one gap-wide time bucket
do. Sessions are therefore found on one row per (trace id, bucket): that table is built with
a combine before the shuffle, and a trace id's share of it is bounded by time, not by how
often the id occurs. No window ever sorts the reports themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.numbers import div
from spanloom.schema import AGE_FACTOR, BLACKLIST_SIZE, MAX_TRACE_SPANS, arrival_order

FEW_ARRIVALS = 1024  # of a trace id, that may all be one task's
BROADCAST_IDS = 50_000  # of trace ids with more arrivals
TASK_ARRIVALS = 100_000  # that a task sorts and groups at a time


def _bucket(gap_us: int) -> Column:
    us = F.unix_micros("received_at")
    return div(us - F.pmod(us, F.lit(gap_us).cast("bigint")), gap_us)


def session_buckets(df: DataFrame, gap_us: int) -> DataFrame:
    """Per (trace id, time bucket): the session it belongs to and that session's extent."""
    us = F.unix_micros("received_at")
    buckets = df.groupBy("trace_id", _bucket(gap_us).alias("bucket")).agg(
        F.min(us).alias("low"), F.max(us).alias("high"), F.count("*").alias("n")
    )
    by_time = W.partitionBy("trace_id").orderBy("bucket")
    idle = F.col("low") - F.lag("high").over(by_time)
    session = W.partitionBy("trace_id", "session_no")
    return (
        buckets.withColumn("opens", F.when(idle < gap_us, 0).otherwise(1))
        .withColumn("session_no", F.sum("opens").over(by_time))
        .select(
            "trace_id", "bucket", "session_no", "n", "low", "high",
            F.min("low").over(session).alias("first_us"),
            F.max("high").over(session).alias("last_us"),
            F.sum("n").over(session).alias("arrivals"),
        )
    )


def _with_bucket(df: DataFrame, gap_us: int) -> DataFrame:
    return df.withColumn("bucket", _bucket(gap_us))


def sessionize(df: DataFrame, gap_us: int) -> DataFrame:
    """Adds session_no: a report at least `gap_us` after the one before starts a new trace."""
    sessions = session_buckets(df, gap_us).select("trace_id", "bucket", "session_no")
    return _with_bucket(df, gap_us).join(sessions, ["trace_id", "bucket"]).drop("bucket")


def judge_buckets(df: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS) -> DataFrame:
    """session_buckets plus the status of the session.

    too_large: more than `max_spans` span ids before the trace reaches its age limit.
    too_old:   open longer than the age limit, which is when the last arrival comes more
               than (limit - gap) after the first.
    blacklisted: a trace of that id before it was too large or too old.
    closed:    everything else; these have at most `max_spans` span ids.
    """
    limit_us = AGE_FACTOR * gap_us
    buckets = session_buckets(df, gap_us)
    # Ids are counted only where there are enough arrivals to break the limit at all.
    suspects = buckets.filter(F.col("arrivals") > max_spans).select(
        "trace_id", "bucket", "session_no", "first_us"
    )
    slim = df.select(
        "trace_id", "span_id", F.unix_micros("received_at").alias("us"),
        _bucket(gap_us).alias("bucket"),
    )
    in_time = F.col("us") <= F.col("first_us") + limit_us
    large = (
        slim.join(suspects, ["trace_id", "bucket"])
        .filter(in_time)
        .groupBy("trace_id", "session_no", "span_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("trace_id", "session_no")
        .agg(F.count("*").alias("ids"))
        .filter(F.col("ids") > max_spans)
        .select("trace_id", "session_no", F.lit(True).alias("large"))
    )
    own = (
        F.when(F.col("large"), "too_large")
        .when(F.col("last_us") - F.col("first_us") > limit_us - gap_us, "too_old")
        .otherwise("closed")
    )
    before = (
        W.partitionBy("trace_id").orderBy("session_no").rangeBetween(W.unboundedPreceding, -1)
    )
    was_bad = F.max(F.col("status") != "closed").over(before)
    return (
        buckets.join(large, ["trace_id", "session_no"], "left")
        .withColumn("status", own)
        .withColumn("status", F.when(was_bad, "blacklisted").otherwise(F.col("status")))
        .drop("large")
    )


def classify_sessions(
    df: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS
) -> DataFrame:
    """One row per trace: its status, extent, arrivals and the time it closed."""
    limit_us = AGE_FACTOR * gap_us
    sessions = (
        judge_buckets(df, gap_us, max_spans)
        .groupBy("trace_id", "session_no")
        .agg(
            *[F.first(c).alias(c) for c in ("status", "first_us", "last_us", "arrivals")],
        )
    )
    idle_at, aged_at = F.col("last_us") + gap_us, F.col("first_us") + limit_us
    return sessions.withColumn("closed_us", F.least(idle_at, aged_at))


def closed_spans(df: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS) -> DataFrame:
    """The reports of all traces that are neither dropped nor blacklisted.

    Adds session_no, the time the trace closed and its number of arrivals.

    Bad traces go in the same join that assigns the sessions, so no later step ever sees
    one: from here on a trace has at most `max_spans` span ids.
    """
    good = (
        judge_buckets(df, gap_us, max_spans)
        .filter(F.col("status") == "closed")
        .select("trace_id", "bucket", "session_no", "last_us", "arrivals")
    )
    joined = _with_bucket(df, gap_us).join(good, ["trace_id", "bucket"])
    return joined.withColumn("closed_us", F.col("last_us") + gap_us).drop("bucket", "last_us")


def closed_together(df: DataFrame, gap_us: int, tasks: int) -> DataFrame:
    """The same where trace ids have few arrivals, none of them too many spans: all arrivals of one are brought to
    one of `tasks`, which is their only shuffle."""
    limit_us = AGE_FACTOR * gap_us
    before = W.partitionBy("trace_id").orderBy("session_no").rangeBetween(W.unboundedPreceding, 0)
    too_old = F.max(F.col("last_us") - F.col("first_us") > limit_us - gap_us).over(before)
    joined = _extents_together(df, gap_us, tasks, lambda sessions: sessions.withColumn("bad", too_old).filter(~F.col("bad")).drop("bad"))
    return joined.withColumn("closed_us", F.col("last_us") + gap_us).drop("first_us", "last_us")


def session_sizes(df: DataFrame, gap_us: int) -> DataFrame:
    """Distinct span ids of every trace up to its age limit, dropped traces included."""
    sessions = session_buckets(df, gap_us).select("trace_id", "bucket", "session_no", "first_us")
    in_time = F.unix_micros("received_at") <= F.col("first_us") + AGE_FACTOR * gap_us
    return (
        _with_bucket(df.select("trace_id", "span_id", "received_at"), gap_us)
        .join(sessions, ["trace_id", "bucket"])
        .filter(in_time)
        .groupBy("trace_id", "session_no", "span_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("trace_id", "session_no")
        .agg(F.count("*").alias("node_count"))
    )


def session_outcomes(
    df: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS
) -> DataFrame:
    """One row per trace: its final status, from ids, parents and arrival times alone.

    Arrivals are counted per trace id first. Trace ids with few are brought to one task each, which is
    the only shuffle of their arrivals; those with many are spread by time and span. Both ways give the same rows.
    Trace ids with many are broadcast if they are at most `BROADCAST_IDS`; beyond that all are spread.

    Statuses are those of judge_buckets, and `closed` becomes `finished` or `no_root`. Adds
    node_count (span ids up to the age limit), arrivals, `late` (arrivals after the age limit,
    when the trace is on the blacklist already) and closed_us.

    A root is a span that is its own parent or whose parent was not reported. So each span is
    counted at its own id and at its parent's: an id with children but no span has as many
    roots. Several roots below one missing parent get a fake root, and that is the only one
    unless its own parent, which is named as the trace is, was reported.
    """
    slim = df.select("trace_id", "span_id", "parent_id", "received_at", "payload_id", "pos")
    ids, tasks = count_arrivals(slim)
    if ids is None:
        return _outcomes(_extents_by_bucket(slim, gap_us), gap_us, max_spans)
    if not ids:
        return _outcomes(_extents_together(slim, gap_us, tasks), gap_us, max_spans)
    few, many = split_by_id(slim, ids)
    few, many = _extents_together(few, gap_us, tasks), _extents_by_bucket(many, gap_us)
    return _outcomes(few, gap_us, max_spans).unionByName(_outcomes(many, gap_us, max_spans))


_EXTENT = ["first_us", "last_us", "arrivals"]


def count_arrivals(df: DataFrame) -> tuple[list[tuple] | None, int]:
    """(trace ids with many arrivals, tasks that all others make up); None for more than `BROADCAST_IDS` ids."""
    counts = df.groupBy("trace_id").agg(F.count("*").alias("n"))
    large = F.when(F.col("n") > FEW_ARRIVALS, F.col("trace_id"))
    told = counts.groupBy(large.alias("trace_id")).agg(F.sum("n").alias("n"))
    rows = told.orderBy(F.asc_nulls_first("trace_id")).limit(BROADCAST_IDS + 2).collect()
    ids = [(r.trace_id,) for r in rows if r.trace_id is not None]
    tasks = -(-sum(r.n for r in rows if r.trace_id is None) // TASK_ARRIVALS) or 1
    return (ids if len(ids) <= BROADCAST_IDS else None), tasks


def split_by_id(df: DataFrame, ids: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(rows of other trace ids, rows of these)."""
    listed = F.broadcast(df.sparkSession.createDataFrame(ids, df.select("trace_id").schema))
    return df.join(listed, "trace_id", "left_anti"), df.join(listed, "trace_id", "left_semi")


def _extents_by_bucket(df: DataFrame, gap_us: int) -> DataFrame:
    """Arrivals with the number and the extent of their session, for trace ids with any number of them."""
    sessions = session_buckets(df, gap_us).select("trace_id", "bucket", "session_no", *_EXTENT)
    return _with_bucket(df, gap_us).join(sessions, ["trace_id", "bucket"])


def _extents_together(
    df: DataFrame, gap_us: int, tasks: int, wanted: Callable[[DataFrame], DataFrame] = lambda sessions: sessions
) -> DataFrame:
    """The same where trace ids have few: all arrivals of one are brought to one of `tasks`, and so are their times.
    Only arrivals of `wanted` sessions are kept."""
    times = df.select("trace_id", "received_at").repartition(tasks, "trace_id")
    sessions = wanted(session_buckets(times, gap_us).select("trace_id", "session_no", *_EXTENT).distinct())
    us = F.unix_micros("received_at")
    within = (us >= F.col("first_us")) & (us <= F.col("last_us"))
    return df.repartition(tasks, "trace_id").alias("a").join(
        sessions.alias("s").hint("shuffle_hash"), (F.col("a.trace_id") == F.col("s.trace_id")) & within
    ).select("a.*", "session_no", *_EXTENT)


def _outcomes(arrivals: DataFrame, gap_us: int, max_spans: int) -> DataFrame:
    """session_outcomes of arrivals that have their session's number and extent."""
    limit_us = AGE_FACTOR * gap_us
    keys = ["trace_id", "session_no", *_EXTENT]  # the extent belongs to the session
    in_time = F.unix_micros("received_at") <= F.col("first_us") + limit_us
    spans = (
        arrivals.groupBy(*keys, "span_id")
        .agg(
            F.coalesce(
                F.min_by("parent_id", F.when(F.col("parent_id") != 0, arrival_order())), F.lit(0)
            ).alias("parent_id"),
            F.max(in_time).alias("in_time"),
            F.count(F.when(~in_time, 1)).alias("late"),
        )
    )
    own_parent = F.col("span_id") == F.col("parent_id")

    def place(node: str, span: Column, kids: Column, late: Column) -> Column:
        return F.struct(
            F.col(node).alias("node"), span.alias("span"), (span & F.col("in_time")).alias("counted"),
            (span & own_parent).alias("own_parent"), kids.cast("bigint").alias("kids"),
            late.cast("bigint").alias("late"),
        )

    as_span = place("span_id", F.lit(True), F.lit(0), F.col("late"))
    as_child = place("parent_id", F.lit(False), F.when(own_parent, 0).otherwise(1), F.lit(0))
    nodes = (
        spans.select(*keys, F.inline(F.array(as_span, as_child)))
        .groupBy(*keys, "node")
        .agg(
            *[F.max(c).alias(c) for c in ("span", "counted", "own_parent")],
            *[F.sum(c).alias(c) for c in ("kids", "late")],
        )
    )
    roots = F.when(F.col("own_parent"), 1).when(~F.col("span"), F.col("kids")).otherwise(0)
    judged = (
        nodes.withColumn("roots", roots)
        .groupBy(*keys)
        .agg(
            F.count(F.when(F.col("counted"), 1)).alias("node_count"),
            F.sum("late").alias("late"), F.sum("roots").alias("roots"),
            F.min(F.when(F.col("roots") > 0, F.col("node"))).alias("low"),
            F.max(F.when(F.col("roots") > 0, F.col("node"))).alias("high"),
            F.max(F.col("span") & (F.col("node") == F.col("trace_id"))).alias("named"),
        )
    )
    fake = (F.col("low") == F.col("high")) & (~F.col("named") | (F.col("low") == F.col("trace_id")))
    own = (
        F.when(F.col("node_count") > max_spans, "too_large")
        .when(F.col("last_us") - F.col("first_us") > limit_us - gap_us, "too_old")
        .when((F.col("roots") == 1) | ((F.col("roots") > 1) & fake), "finished")
        .otherwise("no_root")
    )
    before = W.partitionBy("trace_id").orderBy("session_no").rangeBetween(W.unboundedPreceding, -1)
    was_bad = F.max(F.col("status").isin("too_large", "too_old")).over(before)
    return judged.withColumn("status", own).select(
        "trace_id", "session_no",
        F.when(was_bad, "blacklisted").otherwise(F.col("status")).alias("status"),
        "node_count", "arrivals", "late",
        F.least(F.col("last_us") + gap_us, F.col("first_us") + limit_us).alias("closed_us"),
    )


def blacklist(sessions: DataFrame) -> DataFrame:
    """Trace ids to ignore and since when, from classified sessions."""
    bad = sessions.filter(F.col("status").isin("too_large", "too_old"))
    return bad.groupBy("trace_id").agg(F.min("closed_us").alias("since_us"))


def apply_blacklist(df: DataFrame, listed: DataFrame) -> DataFrame:
    return df.join(listed.select("trace_id"), "trace_id", "left_anti")


def cap_blacklist(listed: DataFrame, size: int = BLACKLIST_SIZE) -> DataFrame:
    """The newest entries; the oldest are evicted first."""
    return listed.orderBy(F.desc("since_us"), F.desc("trace_id")).limit(size)
