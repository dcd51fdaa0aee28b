"""What leaves the system: hook, sink records, batches, recent spans, JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.numbers import format_id, ns_to_timestamp, unsigned_id
from spanloom.schema import TIMINGS, cut_lineage

# Fixed values of the sinks.
EMPTY_RESOURCE = "(resource empty)"
FLUSH_SPANS = 1000
FLUSH_SECONDS = 2
RECENT_SPANS = 2048


def convert(df: DataFrame, hook: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs the user's hook over the spans and drops what it rejects.

    The hook may set `_error`; a span with an error, or without span or trace id, is
    dropped. The other spans of its trace go on.
    """
    converted = df.transform(hook)
    if "_error" in converted.columns:
        converted = converted.filter(F.col("_error").isNull()).drop("_error")
    return converted.filter((F.col("span_id") != 0) & (F.col("trace_id") != 0))


def row_hook(
    schema, fn: Callable[[dict], dict]
) -> Callable[[DataFrame], DataFrame]:
    """A hook for `convert` from a function on one span; what it raises becomes `_error`."""
    names = [f.name for f in schema.fields]
    longs = {f.name for f in schema.fields if f.dataType.typeName() == "long"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for span in batch.to_dict("records"):
                try:
                    rows.append({**fn(dict(span)), "_error": None})
                except Exception as error:  # noqa: BLE001 - the hook is user code
                    rows.append({**span, "_error": str(error) or type(error).__name__})
            # Nullable integers: one missing value must not turn the other ids into floats.
            yield pd.DataFrame({
                c: pd.Series([r.get(c) for r in rows], dtype="Int64" if c in longs else object)
                for c in [*names, "_error"]
            })

    def hook(df: DataFrame) -> DataFrame:
        out = schema.simpleString().removeprefix("struct<").removesuffix(">")
        return df.mapInPandas(run, f"{out},_error:string")

    return hook


def agent_spans(df: DataFrame) -> DataFrame:
    """Spans in the shape a trace agent takes (Datadog's): unsigned ids, error flag, meta."""
    error = F.try_element_at("tags", F.lit("error"))
    is_error = error.isNotNull() & ~error.isin("false", "0")
    extra = [c for c in ("session_no", "closed_us") if c in df.columns]
    return df.select(
        F.when(F.col("name") == "", EMPTY_RESOURCE).otherwise(F.col("name")).alias("resource"),
        F.col("service").alias("name"),
        "service",
        F.col("start_ns").alias("start"),
        F.greatest(F.col("duration_ns"), F.lit(1000).cast("bigint")).alias("duration"),
        unsigned_id(F.col("span_id")).alias("span_id"),
        unsigned_id(F.col("trace_id")).alias("trace_id"),
        unsigned_id(F.col("parent_id")).alias("parent_id"),
        F.col("tags").alias("meta"),
        F.lit(True).alias("sampled"),
        is_error.cast("int").alias("error"),
        *extra,
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.col("trace_id"), F.lit(shards).cast("bigint"))


def assign_batches(
    traces: DataFrame, shards: int = 12, flush_spans: int = FLUSH_SPANS,
    flush_seconds: int = FLUSH_SECONDS,
) -> DataFrame:
    """Puts finished traces into sink batches: adds flush (time window), shard and batch.

    Takes one row per trace with node_count and closed_us. Batches are cut per flush window
    and shard, so the running count never sees more than one window of one shard. A batch
    holds fewer than `flush_spans` spans plus its last trace.
    """
    flush = F.floor(F.col("closed_us") / (flush_seconds * 1_000_000))
    order = (
        W.partitionBy("flush", "shard")
        .orderBy("closed_us", "trace_id", "session_no")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("node_count").over(order), F.lit(0))
    return (
        traces.withColumn("flush", flush)
        .withColumn("shard", _shard(shards))
        .withColumn("batch", F.floor(before / flush_spans))
    )


def trace_batches(spans: DataFrame, keys: Sequence[str] = ("flush", "shard", "batch")) -> DataFrame:
    """One row per batch and trace with the trace's spans; bounded by the batch size."""
    fields = [c for c in spans.columns if c not in {*keys, "trace_id"}]
    return spans.groupBy(*keys, "trace_id").agg(F.collect_list(F.struct(*fields)).alias("spans"))


def emit_order() -> list[Column]:
    return [F.desc("closed_us"), F.desc("trace_id"), F.desc("session_no"), F.asc("span_id")]


def recent_spans(spans: DataFrame, n: int = RECENT_SPANS, shards: int = 64) -> DataFrame:
    """The last `n` emitted spans.

    Two steps: every shard's last n, of which every task keeps n before the shuffle, then
    the last n of those. A plain limit would merge n rows from every task in one. A task's rows are
    of one shard, so that it keeps n and not n for each shard.
    """
    shard = F.pmod(F.spark_partition_id(), F.lit(shards))
    rank = F.row_number().over(W.partitionBy("_shard").orderBy(*emit_order()))
    top = (
        spans.withColumn("_shard", shard).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    )
    return top.drop("_shard", "_rank").orderBy(*emit_order()).limit(n)


def _rfc3339(ns: Column) -> Column:
    """UTC time with as many of nine decimals as needed."""
    seconds = F.date_format(ns_to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.lpad(F.pmod(ns, F.lit(1_000_000_000).cast("bigint")).cast("string"), 9, "0")
    decimals = F.regexp_replace(part, "0+$", "")
    return F.concat(
        seconds, F.when(decimals == "", "").otherwise(F.concat(F.lit("."), decimals)), F.lit("Z")
    )


def spans_to_json(df: DataFrame) -> DataFrame:
    """Spans as JSON text: hex ids, RFC 3339 times, tags by key, empty tags left out."""
    by_key = F.map_from_entries(F.sort_array(F.map_entries("tags")))
    tags = F.when(F.size("tags") > 0, by_key)
    body = F.struct(
        format_id(F.col("span_id")).alias("id"),
        format_id(F.col("parent_id")).alias("parent"),
        format_id(F.col("trace_id")).alias("trace"),
        "name", "service",
        _rfc3339(F.col("start_ns")).alias("timestamp"),
        F.col("duration_ns").alias("duration"),
        tags.alias("tags"),
        F.struct(*[_rfc3339(F.col(t)).alias(t) for t in TIMINGS]).alias("timings"),
    )
    return df.select("trace_id", "span_id", F.to_json(body).alias("json"))


def write_all(df: DataFrame, sinks: Sequence[Callable[[DataFrame], None]], path: str) -> None:
    """Every sink gets every span. The spans are computed once, into a table at `path`."""
    emitted = cut_lineage(df, path)
    for sink in sinks:
        sink(emitted)
