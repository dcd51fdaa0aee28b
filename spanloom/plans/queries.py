"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import numbers as X
from spanloom.functions.clocks import skew
from spanloom.operators import load, merge, metrics, output, sessions, sinks, tree
from spanloom.operators.timings import correct_timings
from spanloom.operators.traces import bounded, collect_traces, correct_traces, judge_traces
from spanloom.plans import assemble
from spanloom.schema import TIMINGS, TRACE, configure, cut_lineage, work_dir
from spanloom.sources import payloads, sharded, tables
from spanloom.streaming import keyed, replay, ticks

ARRIVAL_GAP_US = 10 * tables.HOUR_US
REPORT_GAP_US = 600 * tables.DAY_US
METRICS_GAP_US = 100 * tables.DAY_US
KEYED_LATENESS = "20 days"  # two slices of the replay
MAX_SPANS = 25  # so that some test traces are too large
SHED_CAP = 20_000
TICK_STEPS = ((0, 300 * 86_400), (15_000, 200 * 86_400))
PAYLOAD_GAP_DAYS = 100

Query = Callable[[SparkSession, str], DataFrame]


# --- helpers ---------------------------------------------------------------------------


def tag_text(tags: Column) -> Column:
    pairs = F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ",")


def flat(df: DataFrame) -> DataFrame:
    """No maps and no timestamps, so that engines compare."""
    if "tags" in df.columns:
        df = df.withColumn("tags", tag_text(F.col("tags")))
    for c in ("received_at", "last_at"):
        if c in df.columns:
            df = df.withColumn(c, F.unix_micros(c))
    return df


def one_session(df: DataFrame) -> DataFrame:
    return merge.valid_spans(df).withColumn("session_no", F.lit(1).cast("bigint"))


def merged(spark: SparkSession, sf: str, columns: Sequence[str] = merge.MERGED_COLUMNS) -> DataFrame:
    """Merged spans, of which `columns` are wanted beside the ids."""
    return merge.merge_spans(one_session(tables.span_reports(spark, sf)), TRACE, columns)


def valid_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return merge.valid_spans(tables.arrivals(spark, sf))


def rooted(spark: SparkSession, sf: str, columns: Sequence[str] = merge.MERGED_COLUMNS) -> DataFrame:
    """Spans with fake roots, of the traces with a unique root. Spans are merged once, into a table: the
    joins read their own columns of it."""
    folder = work_dir(spark)
    spans = cut_lineage(merged(spark, sf, columns), f"{folder}/merged")
    return tree.require_unique_root(tree.inject_fake_root(spans, f"{folder}/fakes"))


def open_table(spark: SparkSession, sf: str) -> DataFrame:
    return load.open_traces(one_session(tables.span_reports(spark, sf)))


SPAN_OUT = ["trace_id", "span_id", "parent_id", "name", "service", "start_ns", "duration_ns"]
LINE = SPAN_OUT[2:]  # what of a span is folded for it


# --- queries ---------------------------------------------------------------------------


def ingest_zipkin_v1(spark: SparkSession, sf: str) -> DataFrame:
    return flat(payloads.ingest_zipkin_v1(tables.raw_zipkin_v1(spark, sf)))


def ingest_zipkin_v2(spark: SparkSession, sf: str) -> DataFrame:
    return flat(payloads.ingest_zipkin_v2(tables.raw_zipkin_v2(spark, sf)))


def ingest_jaeger(spark: SparkSession, sf: str) -> DataFrame:
    return flat(payloads.ingest_jaeger(tables.raw_jaeger(spark, sf)))


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    _, rejects = payloads.split_payloads(tables.raw_payloads(spark, sf))
    return rejects.select("payload_id", "protocol", "reason")


def ingest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.raw_payloads(spark, sf)
    return metrics.ingest_metrics(payloads.gate(raw), payloads.ingest_labelled(raw))


def ingest_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.raw_payloads(spark, sf)
    return metrics.ingest_over_time(payloads.gate(raw), payloads.ingest_labelled(raw), "1 hour")


def ingest_stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same per minute, by a stream with a watermark."""
    return replay.replay_ingest_counts(tables.raw_payloads(spark, sf), work_dir(spark), 2, "1 minute", "1 day")


def id_text(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to hex text and back, both signs."""
    key = F.col("o_orderkey")
    ids = tables.table(spark, sf, "orders").select(
        F.when(key % 2 == 0, key * 123457).otherwise(-key * 9871).alias("id")
    )
    text = X.format_id(F.col("id"))
    return ids.select(
        "id", text.alias("text"), X.parse_id(F.upper(text)).alias("parsed"),
        X.unsigned_id(F.col("id")).cast("string").alias("unsigned"),
        X.parse_id(F.substring(text, 14, 3)).alias("short"),
    )


def time_units(spark: SparkSession, sf: str) -> DataFrame:
    spans = tables.span_reports(spark, sf)
    ns = F.col("start_ns") + F.col("duration_ns") - F.col("span_id")
    return spans.select(
        "trace_id", "span_id", ns.alias("ns"), X.ns_to_us(ns).alias("us"), X.ns_to_ms(-ns).alias("ms"),
        X.us_to_ns(X.ns_to_us(ns)).alias("back"),
        F.unix_micros(X.ns_to_timestamp(ns - F.lit(tables.SHIFT_NS))).alias("at_us"),
        X.is_root(F.col("parent_id"), F.col("span_id")).alias("is_root"),
        X.has_parent(F.col("parent_id"), F.col("span_id")).alias("has_parent"),
        X.is_unknown(F.col("parent_id")).alias("unknown_parent"),
        X.is_valid_ts(F.col("cs")).alias("valid_cs"),
    )


def valid_spans(spark: SparkSession, sf: str) -> DataFrame:
    return valid_arrivals(spark, sf).select("trace_id", "span_id", "parent_id", "name", "service")


def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    return flat(merged(spark, sf)).drop("session_no")


def merge_spans_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Early reports merged first and then with the later ones, as open spans of a stream are."""
    reports = merge.valid_spans(tables.span_reports(spark, sf))
    early = F.col("received_at") < F.timestamp_micros(F.lit(9_000 * tables.DAY_US))
    columns = [*reports.columns, "reports", "last_at"]
    some = merge.merge_spans(reports.filter(early), ["trace_id"]).select(*columns)
    rest = reports.filter(~early).withColumns({"reports": F.lit(1).cast("bigint"), "last_at": F.col("received_at")})
    return flat(merge.merge_spans(some.unionByName(rest.select(*columns)), ["trace_id"]))


def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    cut = sessions.sessionize(valid_arrivals(spark, sf), ARRIVAL_GAP_US)
    return cut.select(*TRACE, "span_id", F.unix_micros("received_at").alias("received_at"))


def classify_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.classify_sessions(valid_arrivals(spark, sf), ARRIVAL_GAP_US, MAX_SPANS)


def blacklist(spark: SparkSession, sf: str) -> DataFrame:
    judged = sessions.classify_sessions(valid_arrivals(spark, sf), ARRIVAL_GAP_US, MAX_SPANS)
    return sessions.blacklist(judged)


def cap_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.cap_blacklist(blacklist(spark, sf), 20)


def apply_blacklist(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of another source that a blacklist of trace ids lets through."""
    kept = sessions.apply_blacklist(tables.span_reports(spark, sf), blacklist(spark, sf))
    return kept.select("trace_id", "span_id", "payload_id", "pos")


def closed_spans(spark: SparkSession, sf: str) -> DataFrame:
    closed = sessions.closed_spans(valid_arrivals(spark, sf), ARRIVAL_GAP_US, MAX_SPANS)
    return closed.select(*TRACE, "span_id", "closed_us", "arrivals")


def adaptive_gap(spark: SparkSession, sf: str) -> DataFrame:
    """The gap each user's share of events would lead to, were it the load."""
    per_trace = valid_arrivals(spark, sf).groupBy("trace_id").agg(F.count("*").alias("n"))
    n = F.col("n") * 1500
    return per_trace.select("trace_id", n.alias("open_spans"), load.adaptive_gap(n).alias("gap_s"))


def inflight(spark: SparkSession, sf: str) -> DataFrame:
    return load.inflight(open_table(spark, sf), 4)


def shed_largest(spark: SparkSession, sf: str) -> DataFrame:
    return load.shed_largest(open_table(spark, sf).select("trace_id", "node_count"), SHED_CAP)


def roots(spark: SparkSession, sf: str) -> DataFrame:
    return tree.roots(merged(spark, sf, LINE)).select(*SPAN_OUT)


def children(spark: SparkSession, sf: str) -> DataFrame:
    return tree.children(merged(spark, sf, LINE)).select(*SPAN_OUT, "parent_name", "parent_service")


def by_parent(spark: SparkSession, sf: str) -> DataFrame:
    return tree.by_parent(merged(spark, sf)).select("trace_id", "parent_id", "span_id", "n")


def trace_root(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the user whose id they carry, as roots by id."""
    spans = merge.merge_spans(one_session(tables.arrivals(spark, sf)))
    return tree.storage_order(tree.trace_root(spans)).select(*SPAN_OUT)


def get_span(spark: SparkSession, sf: str) -> DataFrame:
    return tree.get_span(merged(spark, sf), 100, 1603).select(*SPAN_OUT)


def has_span(spark: SparkSession, sf: str) -> DataFrame:
    """Which of all parents named by reports were reported themselves."""
    spans = merged(spark, sf)
    wanted = spans.select(*TRACE, F.col("parent_id").alias("span_id")).distinct()
    return tree.has_span(spans, wanted).drop("session_no")


def same_parent(spark: SparkSession, sf: str) -> DataFrame:
    return tree.same_parent(tree.roots(merged(spark, sf))).drop("session_no")


def fake_roots(spark: SparkSession, sf: str) -> DataFrame:
    return tree.fake_roots(merged(spark, sf)).select(*SPAN_OUT)


def unique_root(spark: SparkSession, sf: str) -> DataFrame:
    return rooted(spark, sf, ["parent_id", "name", "start_ns", "duration_ns", "last_at"]).select(
        "trace_id", "span_id", "parent_id", "name"
    )


def clock_skew(spark: SparkSession, sf: str) -> DataFrame:
    own = skew(*[F.col(t) for t in TIMINGS])
    return merged(spark, sf).select("trace_id", "span_id", own.alias("skew_ns"))


def correct_timings_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    return flat(correct_timings(rooted(spark, sf, [*LINE, *TIMINGS, "tags", "last_at"]))).select(*SPAN_OUT, "tags")


def correct_traces_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flat(correct_traces(bounded(merged(spark, sf)))).select(*SPAN_OUT, "tags")


def trace_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    spans = merged(spark, sf, ["parent_id", "start_ns", "duration_ns", *TIMINGS])
    judged = judge_traces(collect_traces(bounded(spans)))
    return judged.select("trace_id", "node_count", "faked", "status")


def trace_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Cut early, so that both kinds of marker appear."""
    spans = cut_lineage(merged(spark, sf, LINE), f"{work_dir(spark)}/merged")
    outline = tree.trace_outline(spans, max_level=2, max_children=1)
    return outline.drop("session_no")


def corrected_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Reports to corrected spans, through all stages."""
    spans = assemble.correct_spans(tables.span_reports(spark, sf), REPORT_GAP_US)
    return flat(spans).select(*TRACE, *SPAN_OUT[1:], *TIMINGS, "tags", "reports", "closed_us")


def convert_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A column hook that renames services and rejects what has no name."""

    def hook(df: DataFrame) -> DataFrame:
        return df.withColumn("service", F.upper("service")).withColumn(
            "_error", F.when(F.col("name") == "", "no name")
        )

    return output.convert(merged(spark, sf), hook).select(*SPAN_OUT)


def convert_hook_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a function on one span, which raises for what has no name."""

    def rename(span: dict) -> dict:
        if not span["name"]:
            raise ValueError("no name")
        return span | {"service": span["service"].upper()}

    spans = merged(spark, sf).select(*SPAN_OUT)
    return output.convert(spans, output.row_hook(spans.schema, rename))


def agent_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = output.agent_spans(correct_traces(bounded(merged(spark, sf))))
    text_ids = {c: F.col(c).cast("string") for c in ("span_id", "trace_id", "parent_id")}
    return spans.withColumns({**text_ids, "meta": tag_text(F.col("meta"))}).drop("session_no")


def _finished(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = assemble.trace_outcomes(tables.span_reports(spark, sf), REPORT_GAP_US)
    return outcomes.filter(F.col("status") == "finished")


def sink_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of at most ten spans, one row each."""
    day = 86_400
    placed = output.assign_batches(_finished(spark, sf), 3, 10, 30 * day)
    return placed.groupBy("flush", "shard", "batch").agg(
        F.count("*").alias("traces"), F.sum("node_count").alias("spans")
    )


def exact_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches as a sink flushes them that counts anew after each flush, with a timer of 30 days."""
    placed = sinks.flush_batches(_finished(spark, sf), work_dir(spark), 3, 10, 30 * 86_400)
    return placed.groupBy("shard", "batch_tick", "batch_pos").agg(
        F.count("*").alias("traces"), F.sum("node_count").alias("spans"), F.min("closed_us").alias("first_us"), F.max("closed_us").alias("last_us")
    ).drop("batch_tick", "batch_pos")


def trace_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a trace together, per day of closing."""
    columns = ["parent_id", "start_ns", "duration_ns", *TIMINGS]
    spans = assemble.correct_spans(tables.span_reports(spark, sf), REPORT_GAP_US, columns=columns)
    by_day = spans.withColumn("day", F.floor(F.col("closed_us") / tables.DAY_US))
    batches = output.trace_batches(
        by_day.select("day", "trace_id", "span_id", "start_ns"), keys=("day",)
    )
    return batches.select(
        "day", "trace_id", F.size("spans").cast("bigint").alias("n"),
        F.array_join(F.array_sort(F.transform("spans", lambda s: s["span_id"])), ",").alias("span_ids"),
    )


def recent_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = assemble.correct_spans(tables.span_reports(spark, sf), REPORT_GAP_US)
    return output.recent_spans(spans).select(*TRACE, *SPAN_OUT[1:], "closed_us")


def span_json(spark: SparkSession, sf: str) -> DataFrame:
    return output.spans_to_json(merged(spark, sf, [*LINE, *TIMINGS, "tags"]))


def trace_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = assemble.trace_outcomes(tables.span_reports(spark, sf), REPORT_GAP_US)
    return outcomes.select(*TRACE, "status", "arrivals", "closed_us")


def outcome_metrics(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = assemble.trace_outcomes(tables.span_reports(spark, sf), REPORT_GAP_US)
    totals = metrics.outcome_metrics(outcomes)
    return totals.withColumn("status", F.coalesce("status", F.lit("all")))


def outcomes_by_minute(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = assemble.trace_outcomes(tables.span_reports(spark, sf), REPORT_GAP_US)
    return metrics.outcomes_over_time(outcomes, 60_000_000)


def size_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.size_distribution(sessions.session_sizes(valid_arrivals(spark, sf), ARRIVAL_GAP_US))


def span_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """With a gap at which some ids come in after their trace's age limit."""
    outcomes = assemble.trace_outcomes(tables.span_reports(spark, sf), METRICS_GAP_US, 5)
    return metrics.span_metrics(outcomes)


def payload_size(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.payload_size(tables.span_reports(spark, sf))


def trace_size_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Spans per closed trace: sketches per day of closing, added up per status."""
    outcomes = assemble.trace_outcomes(tables.span_reports(spark, sf), REPORT_GAP_US)
    by_day = metrics.size_sketch(
        outcomes.withColumn("day", F.to_date(F.timestamp_micros("closed_us"))), "node_count", "day", "status"
    )
    return metrics.sketch_quantiles(metrics.merge_sketches(by_day, "status"), (0.5, 0.75, 0.95, 0.99), "status")


def span_bytes_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of spans as JSON text: sketches per day of arrival, added up to years."""
    sizes = metrics.span_bytes(tables.span_reports(spark, sf))
    by_day = metrics.size_sketch(sizes.withColumn("day", F.to_date("received_at")), "size", "day")
    by_year = metrics.merge_sketches(by_day.withColumn("year", F.year("day")), "year")
    return metrics.sketch_quantiles(by_year, (0.5, 0.95, 0.99), "year")


def sharded_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """All reports through the sharded table and back."""
    path = f"{work_dir(spark)}/sharded"
    sharded.write_sharded(tables.span_reports(spark, sf), path)
    return flat(sharded.read_sharded(spark, path).drop("shard"))


def exchange_readers(spark: SparkSession, sf: str) -> DataFrame:
    """All reports appended in three slices of arrival, read by two readers at their own pace with
    sweeps in between: what each has got in all, per shard."""
    exchange, reports = sharded.Exchange(spark, f"{work_dir(spark)}/exchange"), tables.span_reports(spark, sf)
    got, step = [], 0
    exchange.store("slow", 0)  # holds back the sweeps from the start
    for slow, part in zip((False, True, True), replay.slices(reports, 3)):
        exchange.append(part)
        for reader in ("fast", "slow") if slow else ("fast",):
            spans, at = exchange.poll(reader)
            step += 1
            got.append(cut_lineage(spans.withColumn("reader", F.lit(reader)), f"{exchange.path}/_got/{step}"))
            exchange.store(reader, at)
        exchange.sweep(9_000_000_000_000_000)
    both = reduce(DataFrame.unionByName, got)
    return both.groupBy("reader", F.pmod("trace_id", F.lit(7)).alias("trace_mod")).agg(
        F.count("*").alias("reports"), F.sum("span_id").alias("span_ids")
    )


def topic_records(spark: SparkSession, sf: str) -> DataFrame:
    """All reports as keyed records and back."""
    records = sharded.to_topic_records(tables.span_reports(spark, sf))
    return flat(sharded.from_topic_records(records))


def keyed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All arrivals through the keyed streaming assembler: the spans of closed traces. Odd ids turn
    negative, and every fifth report comes in a third of the time late."""
    reports = tables.arrivals(spark, sf).withColumn(
        "trace_id", F.when(F.col("trace_id") % 2 == 1, -F.col("trace_id")).otherwise(F.col("trace_id"))
    )
    late = F.col("payload_id") % 5 == 0
    ended = replay.replay_keyed(
        reports, work_dir(spark), 3, ARRIVAL_GAP_US, MAX_SPANS, late, KEYED_LATENESS
    )
    closed = keyed.closed_rows(ended)
    return flat(closed).select(*TRACE, *SPAN_OUT[1:], "tags", "received_at", "reports", "closed_us")


def _ticked(spark: SparkSession, sf: str, **options) -> ticks.TickJob:
    """All reports through the tick job, one tick per slice of time."""
    limits = ticks.Limits(max_open_spans=SHED_CAP, gap_steps=TICK_STEPS)
    return replay.replay_ticks(tables.span_reports(spark, sf), work_dir(spark), 4, limits, **options)


def tick_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What became of traces, tick by tick."""
    return _ticked(spark, sf).results("outcomes").select("trace_id", "node_count", "status", "batch")


def tick_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return _ticked(spark, sf).results("gauges")


def flushed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of spans as the tick job's sink gets them, with a timer of 500 days, and what it holds at the end."""
    folder = work_dir(spark)
    sink = sinks.TableSink("table", f"{folder}/sink")
    job = _ticked(spark, sf, sinks=(sink,), flush=sinks.Flush(3, 100, 500 * 86_400))
    tick = F.col("batch")
    taken = spark.read.parquet(sink.path).withColumn("flushed", F.lit(True))
    held = job.results("held_spans").filter(tick == job.results("gauges").agg(F.max("batch")).scalar())
    held = held.withColumns({
        "shard": F.pmod("trace_id", F.lit(3).cast("bigint")), "batch_tick": F.lit(None).cast("bigint"),
        "batch_pos": F.lit(None).cast("int"), "flushed": F.lit(False),
    })
    return taken.unionByName(held).groupBy("batch", "shard", "batch_tick", "batch_pos", "flushed").agg(
        F.count_distinct("trace_id", "session_no").alias("traces"), F.count("*").alias("spans"),
        F.min("closed_us").alias("first_us"), F.max("closed_us").alias("last_us"),
    ).drop("batch", "batch_tick", "batch_pos")


def dropped_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the traces that the tick job drops or finds without a root."""
    return _ticked(spark, sf, outlines=True).results("outlines").drop("session_no")


def compressed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of gzip files with a payload each."""
    path = f"{work_dir(spark)}/zipped"
    tables.write_supplier_payloads(spark, sf, path)
    spans = payloads.ingest_zipkin_v2(payloads.read_payload_files(spark, path, "json-v2"))
    return flat(spans).select(*SPAN_OUT, *TIMINGS, "tags")


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Spans to a Parquet and a JSON table at once, both read back."""
    folder = work_dir(spark)
    spans = merged(spark, sf, LINE).select(*SPAN_OUT)
    output.write_all(
        spans, [lambda df: df.write.parquet(f"{folder}/columns"), lambda df: df.write.json(f"{folder}/lines", compression="gzip")], f"{folder}/spans"
    )
    columns = spark.read.parquet(f"{folder}/columns").withColumn("sink", F.lit("columns"))
    lines = spark.read.schema(spans.schema).json(f"{folder}/lines").withColumn("sink", F.lit("lines"))
    return columns.unionByName(lines)


def payload_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of all protocols through the running job: outcomes of traces, and rows of the other tables."""
    limits = ticks.Limits(gap_steps=((0, PAYLOAD_GAP_DAYS * 86_400),))
    job = replay.replay_payloads(tables.raw_payloads(spark, sf), work_dir(spark), 2, limits)
    outcomes = job.results("outcomes").groupBy(F.col("status").alias("what"), "batch").agg(
        F.count("*").alias("n"), F.sum("node_count").alias("total")
    )
    dead = job.results("dead_letters").groupBy(F.lit("dead").alias("what"), "batch").agg(
        F.count("*").alias("n"), F.sum("payload_id").alias("total")
    )
    spans = job.results("ingested").groupBy(F.lit("ingested").alias("what"), "batch").agg(
        F.sum("payloads").alias("n"), F.sum("spans").alias("total")
    )
    emitted = job.results("emitted").groupBy(F.lit("emitted").alias("what"), "batch").agg(
        F.count("*").alias("n"), F.sum(F.col("span_id") % 1000).alias("total")
    )
    return outcomes.unionByName(dead).unionByName(spans).unionByName(emitted)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        ingest_zipkin_v1, ingest_zipkin_v2, ingest_jaeger, dead_letters, ingest_metrics, id_text,
        time_units, valid_spans, merge_spans, merge_spans_by_rows, sessionize, classify_sessions,
        blacklist, cap_blacklist, apply_blacklist, closed_spans, adaptive_gap, inflight,
        shed_largest, roots, children, by_parent, trace_root, get_span, has_span, same_parent,
        fake_roots, unique_root, clock_skew, correct_timings_by_joins, correct_traces_by_rows,
        trace_verdicts, trace_outline, corrected_spans, convert_hook, agent_spans, sink_batches,
        trace_batches, recent_spans, span_json, trace_outcomes, outcome_metrics,
        size_distribution, span_metrics, payload_size, sharded_exchange, topic_records,
        ingest_by_hour, ingest_stream_counts, outcomes_by_minute, exact_batches,
        exchange_readers, trace_size_quantiles, span_bytes_by_year, convert_hook_by_rows,
        flushed_stream, dropped_outlines,
        keyed_stream, tick_stream, tick_gauges, compressed_payloads, fan_out, payload_stream,
    )
}


def configured(query: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return query(configure(spark), sf)

    return run
