import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import load, output
from spanloom.sources import sharded
from spanloom.plans.queries import tag_text
from tests.spans import BASE_NS, frame, report


def test_adaptive_gap(spark):
    loads = [0, 39_999, 40_000, 60_000, 80_000, 10**9]
    df = spark.createDataFrame([(n,) for n in loads], "n long").coalesce(1)
    assert [r[0] for r in df.select(load.adaptive_gap(F.col("n"))).collect()] == [8, 8, 6, 4, 2, 2]


def test_inflight_leaves_out_large(spark):
    df = spark.createDataFrame([(1, 3), (2, 9000), (3, 8192)], "trace_id long, node_count long")
    assert load.inflight(df).first() == (8195, 3)


@pytest.mark.parametrize("seed", range(4))
def test_shedding_is_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {t: rng.randint(1, 6) for t in range(1, 300)}
    total = sum(sizes.values())
    cap = rng.choice([0, 1, total // 3, total - 1, total, total + 1])
    df = spark.createDataFrame(list(sizes.items()), "trace_id long, node_count long")
    shed = [r.node_count for r in load.shed_largest(df, cap).collect()]
    want, left = [], total
    for n in sorted(sizes.values(), reverse=True):
        if left < cap:
            break
        want.append(n)
        left -= n
    assert sorted(shed, reverse=True) == want


def test_agent_error_flag(spark):
    tags = [{}, {"error": ""}, {"error": "false"}, {"error": "0"}, {"error": "true"}, {"error": "False"}]
    rows = [report(-1, i + 1, tags=t, duration_ns=i * 900) for i, t in enumerate(tags)]
    got = output.agent_spans(frame(spark, rows)).orderBy("span_id").collect()
    assert [r.error for r in got] == [0, 1, 0, 0, 1, 1]
    assert got[0].trace_id == 2**64 - 1 and got[0].resource == "(resource empty)"
    assert [r.duration for r in got[:3]] == [1000, 1000, 1800]


def test_hooks(spark):
    df = frame(spark, [report(1, i, name=n) for i, n in enumerate(("", "a", "b", "c"))])

    def rename(span):
        if span["name"] == "b":
            raise ValueError("no b")
        return {**span, "name": span["name"].upper()}

    got = output.convert(df, output.row_hook(df.schema, rename))
    assert sorted(r.name for r in got.collect()) == ["A", "C"]
    assert got.columns == df.columns and output.convert(df).count() == 3


def test_row_hook_keeps_ids_exact(spark):
    """A hook that drops one id must not turn the column into floats."""
    big = (1 << 53) + 1
    df = frame(spark, [report(big, big), report(big, 2)])
    lose = lambda span: {**span, "trace_id": None} if span["span_id"] == 2 else span
    got = output.convert(df, output.row_hook(df.schema, lose)).collect()
    assert [(r.trace_id, r.span_id) for r in got] == [(big, big)]


def test_topic_records_keep_microseconds(spark):
    df = frame(spark, [report(1, 2, at=0.123456)])
    back = sharded.from_topic_records(sharded.to_topic_records(df))
    assert back.first().received_at == df.first().received_at and back.first().received_at.microsecond == 123456


def test_json(spark):
    rows = [report(1, -1, 2, start_ns=BASE_NS + 1_500, tags={"b": "2", "a": "x\"y"}), report(1, 2)]
    got = [json.loads(r.json) for r in output.spans_to_json(frame(spark, rows)).orderBy("span_id").collect()]
    assert got[0]["id"] == "f" * 16 and got[0]["parent"] == "0" * 15 + "2"
    assert got[0]["timestamp"] == "2024-01-01T00:00:00.0000015Z" and got[0]["tags"] == {"a": "x\"y", "b": "2"}
    assert "tags" not in got[1] and got[1]["timings"]["cs"] == "1970-01-01T00:00:00Z"


def test_recent_spans(spark):
    df = spark.range(10_000).select(
        (F.col("id") % 7).alias("trace_id"), F.lit(1).alias("session_no"),
        F.col("id").alias("span_id"), (F.col("id") % 1000).alias("closed_us"),
    )
    got = output.recent_spans(df).collect()
    want = sorted(df.collect(), key=lambda r: (-r.closed_us, -r.trace_id, -r.session_no, r.span_id))[:2048]
    assert got == want


def test_batches(spark):
    traces = spark.range(1, 500).select(
        F.col("id").alias("trace_id"), F.lit(1).alias("session_no"),
        (F.col("id") % 9 + 1).alias("node_count"), (F.col("id") * 10_000).alias("closed_us"),
    )
    placed = output.assign_batches(traces, shards=2, flush_spans=50)
    sums = placed.groupBy("flush", "shard", "batch").agg(F.sum("node_count").alias("n")).collect()
    assert sum(r.n for r in sums) == traces.agg(F.sum("node_count")).first()[0]
    assert max(r.n for r in sums) < 50 + 9 and len(sums) > 6


def test_write_all(spark, tmp_path):
    seen = []
    output.write_all(spark.range(5), [lambda d: seen.append(d.count())] * 2, str(tmp_path / "out"))
    assert seen == [5, 5]


def test_sharded_round_trip(spark, tmp_path):
    rng = random.Random(1)
    number = lambda: rng.randint(-(2**63), 2**63 - 1)
    rows = [
        report(number(), number(), number(), at=i, name=f"n{i}", start_ns=number(), cs=number(),
               tags={f"k{j}": str(number()) for j in range(3)}) for i in range(2000)
    ]
    df = frame(spark, rows)
    path = str(tmp_path / "s")
    sharded.write_sharded(df, path)
    back = sharded.read_sharded(spark, path)
    flat = lambda d: sorted(d.withColumn("tags", tag_text(F.col("tags"))).drop("shard").collect())
    assert flat(back) == flat(df)
    assert back.groupBy("trace_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sharded.read_sharded(spark, path, [3]).select("shard").distinct().collect()[0][0] == 3
    records = sharded.to_topic_records(df)
    broken = spark.createDataFrame([(b"1", b"no span"), (b"1", b"")], "key binary, value binary")
    assert flat(sharded.from_topic_records(records.unionByName(broken))) == flat(df)


def test_shedding_tells_ids_with_equal_low_bits_apart(spark):
    """Ties are settled by all bits of an id, so such ids spread over the cells."""
    traces = spark.range(2000).select((F.col("id") * 2**40 + 7).alias("trace_id"), F.lit(3).cast("bigint").alias("node_count"))
    gone = load.shed_largest(traces, 3000)
    assert gone.count() == 1001
    cells = traces.select(F.shiftright(load._tie(F.col("trace_id")), 16).alias("cell")).distinct().count()
    assert cells > 1500
