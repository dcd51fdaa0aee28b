"""Shape of the plans: what is read, what is shuffled, and what hot keys do."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import output, sessions, timings, tree
from spanloom.operators.merge import merge_spans
from spanloom.operators.traces import collect_traces, correct_traces, judge_traces
from spanloom.plans import assemble, queries
from spanloom.plans.assemble import LIST_LIMIT
from spanloom.sources import payloads, tables
from tests.conftest import SMALL
from tests.spans import frame, merged_frame, report


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ingest_does_not_shuffle_and_parses_twice(spark, tmp_path):
    tables.raw_zipkin_v2(spark, SMALL).write.parquet(str(tmp_path / "raw"))
    text = plan(payloads.ingest_zipkin_v2(payloads.read_payload_table(spark, str(tmp_path / "raw"))))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("from_json(") == 2


def test_correction_is_one_shuffle(spark):
    text = plan(correct_traces(merged_frame(spark, [report()])))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_assembly_shuffles_wide_rows_twice(spark, tmp_path, no_broadcast):
    """For traces with few arrivals: once to find the session, once to bring the trace together."""
    frame(spark, [report()]).write.parquet(str(tmp_path / "r"))
    text = plan(assemble.correct_spans(spark.read.parquet(str(tmp_path / "r")), 8_000_000))
    few = text[: text.index("min_by")] if "min_by" in text else text
    above_join = few[: few.index("SortMergeJoin")]
    assert above_join.count("Exchange") == 1 and "trace_id" in above_join


def test_small_traces_are_shuffled_once_from_report_to_trace(spark, tmp_path):
    """Merging brings a trace together, and only the columns that are wanted."""
    frame(spark, [report(1, 1), report(1, 2, 1), report(2, 1)], session_no=1).write.parquet(str(tmp_path / "r"))
    columns = ["parent_id", "start_ns", "duration_ns", "cs", "cr", "ss", "sr"]
    spans = merge_spans(spark.read.parquet(str(tmp_path / "r")), columns=columns)
    text = plan(judge_traces(collect_traces(spans)))
    assert text.count("Exchange hashpartitioning(trace_id") == 1
    assert "sr#" in text and not re.search(r"\b(tags|name|service)#", text)


def test_timings_move_no_times_while_jumping(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timings, "work_dir", lambda spark: str(tmp_path))
    timings.correct_timings(merged_frame(spark, [report(1, 1, 1), report(1, 2, 1), report(1, 3, 2)])).collect()
    linked = spark.read.parquet(str(tmp_path / "linked"))
    assert set(linked.columns) == {"trace_id", "session_no", "span_id", "ptr", "sum", "parent"}


def test_fake_roots_are_written_once(spark, tmp_path):
    spans = merged_frame(spark, [report(5, 1, 9), report(5, 2, 9), report(2, 1, 1)])
    got = tree.require_unique_root(tree.inject_fake_root(spans, str(tmp_path / "fakes")))
    assert spark.read.parquet(str(tmp_path / "fakes")).count() == 1
    assert sorted((r.trace_id, r.span_id) for r in got.collect()) == [(2, 1), (5, 1), (5, 2), (5, 9)]


def test_slim_scan_for_sessions(spark):
    text = plan(sessions.classify_sessions(tables.arrivals(spark, SMALL), 8_000_000))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert read and all(set(re.findall(r"(\w+):", r)) <= {"event_id", "ts", "user_id"} for r in read)


def hot(spark, n):
    """A third of all rows is one trace id, most of it one span."""
    base = frame(spark, [report()]).drop("trace_id", "span_id", "received_at", "payload_id")
    i = F.col("id")
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 10)
    return spark.range(n).select(
        F.when(i % 3 == 0, 1).otherwise(i + 10).cast("bigint").alias("trace_id"),
        F.when(i % 3 == 0, F.when(i % 999 == 0, 2 + i % 50).otherwise(1)).otherwise(1).cast("bigint").alias("span_id"),
        at.alias("received_at"), i.alias("payload_id"),
    ).crossJoin(base).withColumn("parent_id", F.lit(1).cast("bigint")).select(
        *frame(spark, [report()]).columns
    )


def test_hot_trace_merges_as_rows(spark):
    n = 6 * LIST_LIMIT
    df = hot(spark, n)
    spans = assemble.correct_spans(df, 8_000_000).filter("trace_id = 1")
    got = spans.agg(F.sum("reports"), F.max("reports"), F.count("*")).first()
    assert got[0] == n // 3 and got[1] > LIST_LIMIT and got[2] > 1


def test_hot_span_merges_without_adaptive_plans(spark):
    """Its reports are combined in each task, so that few rows of it are shuffled."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = merge_spans(hot(spark, 200_000), ["trace_id"])
        text = plan(merged)
        assert "SortMergeJoin" not in text and text.index("partial_min_by") > text.index("Exchange")
        got = merged.filter("trace_id = 1").agg(F.sum("reports"), F.max("reports")).first()
        assert got[0] == 66_667 and got[1] > 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_hot_key_is_split_in_the_session_join(spark, tmp_path, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10KB",
    }
    hot(spark, 300_000).repartition(16).write.parquet(str(tmp_path / "hot"))
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        cut = sessions.sessionize(spark.read.parquet(str(tmp_path / "hot")), 8_000_000)
        assert len(cut.collect()) == 300_000
        assert "SortMergeJoin(skew=true)" in plan(cut)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nothing_in_the_main_plan_is_python(spark):
    assert "Python" not in plan(queries.corrected_spans(spark, SMALL))


def test_outcomes_read_ids_and_times_twice(spark, tmp_path, no_broadcast):
    frame(spark, [report()]).write.parquet(str(tmp_path / "r"))
    text = plan(assemble.trace_outcomes(spark.read.parquet(str(tmp_path / "r")), 8_000_000))
    read = re.findall(r"ReadSchema: struct<([^>\n]*)", text)
    wanted = {"trace_id", "span_id", "parent_id", "received_at", "payload_id", "pos"}
    assert len(read) == 2 and all(set(re.findall(r"(\w+):", r)) <= wanted for r in read)
    assert text.count("Join") == 1


def test_no_stage_runs_as_one_method_that_is_never_compiled(spark):
    """The JVM interprets methods of more than 8000 bytes; Spark itself takes such stages up to 65535."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_outcomes_of_small_traces_shuffle_arrivals_once(spark, tmp_path, no_broadcast, monkeypatch):
    monkeypatch.setattr(sessions, "TASK_ARRIVALS", 1)  # so that there are several tasks
    frame(spark, [report(1, 1), report(1, 2, 1), report(2, 1)]).write.parquet(str(tmp_path / "r"))
    text = plan(assemble.trace_outcomes(spark.read.parquet(str(tmp_path / "r")), 8_000_000))
    assert text.count("Exchange ") == text.count("Exchange hashpartitioning(trace_id") == 2


def test_correction_reads_only_wanted_columns(spark, tmp_path, monkeypatch):
    rows = [report(1, 1, name="a"), report(1, 2, 1, tags={"k": "v"}), report(7, 1, 9), report(7, 2, 9, sr=5), report(7, 2, 9, name="b")]
    frame(spark, rows).write.parquet(str(tmp_path / "r"))
    reports = spark.read.parquet(str(tmp_path / "r"))
    columns = ["parent_id", "start_ns", "duration_ns", "cs", "cr", "ss", "sr"]
    for limit in (LIST_LIMIT, 1):
        monkeypatch.setattr(assemble, "LIST_LIMIT", limit)
        spans = assemble.correct_spans(reports, 8_000_000, columns=columns)
        assert "tags:" not in plan(spans) and "service:" not in plan(spans)
        whole = assemble.correct_spans(reports, 8_000_000).select(*spans.columns)
        assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, whole.collect()))
        assert spans.count() == 5


def test_small_trace_ids_are_shuffled_once_from_report_to_corrected_span(spark, tmp_path, no_broadcast, monkeypatch):
    """Sessions are found where a trace is merged and corrected; the result is that of spreading arrivals by time."""
    gap_us = 8_000_000
    rows = [
        report(t, i + 1, i, at=at, payload_id=i, name=f"{t}-{i}")
        for t, times in {
            1: (0, 1, 2), 2: (0, 20, 21), 3: (0, 7, 14, 21, 28, 35, 42, 90), 4: (0, 200, *range(300, 350, 7), 900), 5: (0, 8, 7, 0),
        }.items()
        for i, at in enumerate(times)
    ]
    frame(spark, rows).write.parquet(str(tmp_path / "r"))
    reports = spark.read.parquet(str(tmp_path / "r"))
    outcome = lambda df: sorted(str(r) for r in df.withColumn("tags", F.map_entries("tags")).collect())
    spread = outcome(assemble.correct_spans(reports, gap_us))
    monkeypatch.setattr(sessions, "TASK_ARRIVALS", 1)  # so that there are several tasks
    spans = assemble.correct_spans(reports, gap_us)
    text = plan(spans)
    assert text.count("Exchange ") == text.count("Exchange hashpartitioning(trace_id") == 2
    assert outcome(spans) == spread and len(spread) == 3 + 3 + 2 + 4
    monkeypatch.setattr(sessions, "FEW_ARRIVALS", 3)  # so that some ids are spread
    assert outcome(assemble.correct_spans(reports, gap_us)) == spread


def test_each_task_keeps_the_recent_spans_only(spark):
    spans = merged_frame(spark, [report(t, 1, 1) for t in range(1, 9)]).withColumn("closed_us", F.col("trace_id"))
    recent = output.recent_spans(spans.repartition(4), 3)
    assert "WindowGroupLimit" in plan(output.recent_spans(spans)) and [r.trace_id for r in recent.collect()] == [8, 7, 6]
