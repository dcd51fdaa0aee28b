"""Dropping invalid spans and merging the reports of one span (A1, A2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.normalise import last_wins_map
from spanloom.schema import TIMINGS, TRACE

FEW_REPORTS = 64  # of a span, that may be one list
BROADCAST_IDS = 50_000  # of spans with more reports

# What a merged span carries, beside its keys.
MERGED_COLUMNS = [
    "parent_id", "name", "service", "start_ns", "duration_ns", *TIMINGS, "tags",
    "received_at", "payload_id", "pos", "last_at", "reports",
]


def valid_spans(df: DataFrame) -> DataFrame:
    return df.filter((F.col("trace_id") != 0) & (F.col("span_id") != 0))


def _with_counts(df: DataFrame) -> DataFrame:
    """Merged spans coming in again (streaming state) bring their counts along."""
    if "reports" in df.columns:
        return df
    return df.withColumn("reports", F.lit(1).cast("bigint")).withColumn(
        "last_at", F.col("received_at")
    )


def merge_spans(df: DataFrame, keys: Sequence[str] = TRACE, columns: Sequence[str] = MERGED_COLUMNS) -> DataFrame:
    """One row per span from any number of reports, as if folded in arrival order.

    The first report is the base: its start, duration and timings stay. Parent, name,
    service and tags are filled from later ones, and replaced by later server reports.

    Only `columns` are folded; the others of a report are not shuffled either.

    Reports are counted per trace id first, and per span in those with many, on ids alone, combined before
    their shuffle. Spans with few
    reports are folded as bounded lists, after one shuffle and without a row per tag; a span with one
    report only passes through. Spans with more are folded by `combine_reports`. Both ways are exact.
    The ids of spans with many reports are broadcast if they are at most `BROADCAST_IDS`, so that
    a hot span is combined before any shuffle; beyond that they are joined.

    Where no trace id has many reports that shuffle is by trace id, the first of the keys, so that what
    follows trace by trace needs no other.
    """
    df = _with_counts(df)
    ids = [*keys, "span_id"]
    trace = [*keys][:1]

    def often(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > FEW_REPORTS).select(*by)

    # A span with many reports is in a trace with many: ids are counted only in those, if they are few.
    large = often(df, trace)
    traces = large.limit(BROADCAST_IDS + 1).collect()
    if not traces:
        return fold_lists(df, keys, columns, together=True)
    slim = df.select(*ids)
    if len(traces) <= BROADCAST_IDS:
        slim = slim.join(F.broadcast(df.sparkSession.createDataFrame(traces, large.schema)), trace, "left_semi")
    many = often(slim, ids)
    known = many.limit(BROADCAST_IDS + 1).collect()
    if not known:
        return fold_lists(df, keys, columns)
    if len(known) <= BROADCAST_IDS:
        many = F.broadcast(df.sparkSession.createDataFrame(known, many.schema))
    else:
        many = many.hint("shuffle_hash")
    few = fold_lists(df.join(many, ids, "left_anti"), keys, columns)
    return few.unionByName(combine_reports(df.join(many, ids, "left_semi"), keys).select(*ids, *columns))


def combine_reports(df: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """The same as merge_spans for spans with very many reports.

    Every field of the fold is the first or the last qualifying value in arrival order, so
    all of it is min_by/max_by, which combine before the shuffle: a span reported a billion
    times is one row per map task afterwards. Tags fold per key, so a report becomes one row
    for its fixed fields (key is null) and one per tag; the second grouping puts them
    together again.
    """
    keys = [*keys, "span_id"]
    no_tag = F.array(
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    )
    rows = _with_counts(df).select(
        *keys,
        F.struct("received_at", "payload_id", "pos").alias("at"),
        ((F.col("sr") > 0) | (F.col("ss") > 0)).alias("server"),
        "parent_id", "name", "service",
        F.struct("start_ns", "duration_ns", *TIMINGS).alias("own"),
        "reports", "last_at",
        F.explode(F.concat(no_tag, F.map_entries("tags"))).alias("tag"),
    )
    fixed = ["parent_id", "name", "service", "own", "reports", "last_at"]
    key, at, server = F.col("tag.key"), F.col("at"), F.col("server")
    # Tag rows leave the fixed fields empty, so each travels once per report.
    rows = rows.select(
        *keys, "at", "server", key.alias("key"), F.col("tag.value").alias("value"),
        *[F.when(key.isNull(), F.col(c)).alias(c) for c in fixed],
    )
    name, service, own = F.col("name"), F.col("service"), F.col("own")

    folded = rows.groupBy(*keys, "key").agg(
        F.min("at").alias("at"),
        F.min_by("own", "at").alias("own"),
        F.min_by("parent_id", F.when(F.col("parent_id") != 0, at)).alias("parent_id"),
        F.max_by("name", F.when(server & (name != ""), at)).alias("server_name"),
        F.min_by("name", F.when(name != "", at)).alias("first_name"),
        F.max_by("service", F.when(server & (service != ""), at)).alias("server_service"),
        F.min_by("service", F.when(service != "", at)).alias("first_service"),
        *[
            F.max_by(own[c], F.when(~server & (own[c] > 0), at)).alias(c) for c in ("cs", "cr")
        ],
        *[F.max_by(own[c], F.when(own[c] > 0, at)).alias(c) for c in ("ss", "sr")],
        F.max_by("value", F.when(server, at)).alias("server_value"),
        F.min_by("value", "at").alias("first_value"),
        F.sum("reports").alias("reports"),
        F.max("last_at").alias("last_at"),
    )

    fixed_row = F.col("key").isNull()

    def once(value, name: str):
        return F.first(F.when(fixed_row, value), ignorenulls=True).alias(name)

    spans = folded.groupBy(*keys).agg(
        once(F.coalesce("parent_id", F.lit(0).cast("bigint")), "parent_id"),
        once(F.coalesce("server_name", "first_name", F.lit("")), "name"),
        once(F.coalesce("server_service", "first_service", F.lit("")), "service"),
        once(F.col("own.start_ns"), "start_ns"),
        once(F.col("own.duration_ns"), "duration_ns"),
        *[once(F.coalesce(F.col(c), F.col(f"own.{c}")), c) for c in TIMINGS],
        F.map_from_entries(
            F.collect_list(
                F.when(
                    ~fixed_row,
                    F.struct("key", F.coalesce("server_value", "first_value").alias("value")),
                )
            )
        ).alias("tags"),
        once(F.col("at"), "at"),
        once(F.col("last_at"), "last_at"),
        once(F.col("reports"), "reports"),
    )
    return spans.select("*", "at.*").select(*keys, *MERGED_COLUMNS)


def fold_lists(
    df: DataFrame, keys: Sequence[str] = TRACE, columns: Sequence[str] = MERGED_COLUMNS, together: bool = False
) -> DataFrame:
    """The same as merge_spans by folding each span's list of reports, after one shuffle.

    The lists must be bounded, and nothing is combined before the shuffle: it is for traces that
    are known to be small. `together` brings each trace id, the first of the keys, to one task.
    """
    trace, keys = F.col(keys[0]), [*keys, "span_id"]
    server = ((F.col("sr") > 0) | (F.col("ss") > 0)).alias("server")
    by_role = {"name", "service", "cs", "cr", "tags"}.intersection(columns)
    wanted = [c for c in ("parent_id", "name", "service", "start_ns", "duration_ns", *TIMINGS, "reports", "last_at") if c in columns]
    entries = [F.map_entries("tags").alias("entries")] if "tags" in columns else []
    report = ["received_at", "payload_id", "pos", *(["server"] if by_role else []), *wanted, *(["entries"] if entries else [])]
    rows = _with_counts(df).select(*keys, "received_at", "payload_id", "pos", *([server] if by_role else []), *wanted, *entries)
    if together:
        rows = rows.repartition(trace)
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*report))).alias("r"))
    r = F.col("r")
    base = F.get(r, F.lit(0))

    def first(name: str, wanted) -> Column:
        return F.get(F.filter(r, wanted), F.lit(0))[name]

    def last(name: str, wanted) -> Column:
        return F.try_element_at(F.filter(r, wanted), F.lit(-1))[name]

    def text(name: str) -> Column:
        return F.coalesce(
            last(name, lambda x: x["server"] & (x[name] != "")),
            first(name, lambda x: x[name] != ""),
            F.lit(""),
        )

    def client(name: str) -> Column:
        return F.coalesce(last(name, lambda x: ~x["server"] & (x[name] > 0)), base[name])

    # Of equal keys the last entry stays: first values in reverse, then server values.
    def tags() -> Column:
        entries = F.flatten(
            F.concat(
                F.transform(F.reverse(r), lambda x: F.reverse(x["entries"])),
                F.transform(F.filter(r, lambda x: x["server"]), lambda x: x["entries"]),
            )
        )
        return F.when(single, F.map_from_entries(base["entries"])).otherwise(last_wins_map(entries))

    folded = {
        "parent_id": lambda: F.coalesce(
            first("parent_id", lambda x: x["parent_id"] != 0), F.lit(0).cast("bigint")
        ),
        "name": lambda: text("name"),
        "service": lambda: text("service"),
        "cs": lambda: client("cs"),
        "cr": lambda: client("cr"),
        "ss": lambda: F.coalesce(last("ss", lambda x: x["ss"] > 0), base["ss"]),
        "sr": lambda: F.coalesce(last("sr", lambda x: x["sr"] > 0), base["sr"]),
        "reports": lambda: F.aggregate(r, F.lit(0).cast("bigint"), lambda n, x: n + x["reports"]),
        "last_at": lambda: F.array_max(F.transform(r, lambda x: x["last_at"])),
    }
    single = F.size(r) == 1
    out = []
    for c in columns:
        if c == "tags":
            out.append(tags().alias(c))
        elif c in folded:
            out.append(F.when(single, base[c]).otherwise(folded[c]()).alias(c))
        else:
            out.append(base[c].alias(c))
    return lists.select(*keys, *out)
