import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions.clocks import skew
from spanloom.operators import tree as T
from spanloom.operators.timings import correct_timings
from spanloom.operators.traces import bounded, collect_traces, correct_traces, judge_traces
from tests.spans import BASE_NS, merged_frame, report, walk

MS = 1_000_000


def ids(df):
    return sorted((r.trace_id, r.span_id) for r in df.collect())


def test_children_and_roots(spark):
    df = merged_frame(spark, [report(1, 1), report(1, 2, 1), report(2, 5, 5), report(2, 6, 5)])
    assert ids(T.children(df)) == [(1, 2), (2, 6)]
    assert ids(T.roots(df)) == [(1, 1), (2, 5)]
    assert ids(T.trace_root(df)) == [(1, 1)]
    assert ids(T.get_span(df, 2, 6)) == [(2, 6)]
    rows = sorted((r.trace_id, r.parent_id, r.span_id, r.n) for r in T.by_parent(df).collect())
    assert rows == [(1, 0, 1, 1), (1, 1, 2, 1), (2, 5, 5, 2), (2, 5, 6, 2)]


# The nine edge cases: spans as (id, parent) of trace 100, and whether the trace is kept.
CASES = {
    "one candidate with a missing parent": ([(1, 7), (2, 1)], True, False),
    "shared missing parent": ([(1, 7), (2, 7)], True, True),
    "shared parent is the trace id": ([(1, 100), (2, 100)], True, True),
    "fake root hangs below a span": ([(1, 7), (2, 7), (100, 1)], False, True),
    "several without parent": ([(1, 0), (2, 0)], True, True),
    "several without parent, one is the trace id": ([(1, 0), (100, 0)], False, True),
    "different parents": ([(1, 7), (2, 8)], False, False),
    "cycle beside a root": ([(1, 1), (2, 3), (3, 2)], True, False),
    "cycle only": ([(2, 3), (3, 2)], False, False),
}


@pytest.mark.parametrize("name", CASES)
def test_edge_cases(spark, name):
    spans, kept, faked = CASES[name]
    df = merged_frame(spark, [report(100, i, p) for i, p in spans])
    (verdict,) = judge_traces(collect_traces(df)).collect()
    assert (verdict.status == "finished", verdict.faked) == (kept, faked)
    assert verdict.node_count == len(spans)
    grown = T.inject_fake_root(df)
    assert grown.count() == len(spans) + faked
    by_joins = T.require_unique_root(grown)
    assert ids(by_joins) == ids(correct_traces(df))
    assert (by_joins.count() > 0) == kept


def test_fake_root_extent(spark):
    df = merged_frame(spark, [report(9, 1, 7, start_ns=50, duration_ns=5), report(9, 2, 7, start_ns=20, duration_ns=90)])
    (fake,) = T.fake_roots(df).collect()
    assert (fake.span_id, fake.parent_id, fake.start_ns, fake.duration_ns) == (7, 9, 20, 90)
    assert fake.name == fake.service == "fake-root" and fake.tags == {}


def test_fake_root_extent_wraps_around(spark):
    late = (1 << 63) - 10
    df = merged_frame(spark, [report(9, 1, 7, start_ns=late, duration_ns=20), report(9, 2, 7, start_ns=-late, duration_ns=1)])
    (fake,) = T.fake_roots(df).collect()
    assert (fake.start_ns, fake.duration_ns) == (-late, 1)


def test_skew(spark):
    df = spark.createDataFrame([(100, 201, 1110, 1190), (1, 2, 0, 3), (-5, -2, 3, 4)], "cs long, cr long, sr long, ss long")
    got = [r[0] for r in df.select(skew(F.col("cs"), F.col("cr"), F.col("ss"), F.col("sr"))).collect()]
    assert got == [150 - 1150, 0, -3 - 3]


def corrected(spark, rows, offset=0):
    df = merged_frame(spark, rows)
    return [
        {(r.trace_id, r.span_id): (r.start_ns, r.duration_ns) for r in fix(df, offset).collect()}
        for fix in (correct_traces, correct_timings)
    ]


def test_shared_span_skew(spark):
    """Client, a span both sides report, and a server span whose clock is 250 ms ahead."""
    def at(ms):
        return BASE_NS + ms * MS

    rows = [
        report(1, 1, 1, start_ns=at(40), cs=at(40), cr=at(100)),
        report(1, 2, 1, start_ns=at(40), cs=at(40), cr=at(100), sr=at(305), ss=at(335)),
        report(1, 3, 2, start_ns=at(305), duration_ns=30 * MS, sr=at(305), ss=at(335)),
    ]
    for got in corrected(spark, rows, 7):
        assert got[1, 1][0] == at(40) + 7 and got[1, 2] == (at(40) + 7, 60 * MS)
        assert got[1, 3] == (at(55) + 7, 30 * MS)


def test_broken_start_takes_parent(spark):
    rows = [report(1, 1, 1, start_ns=5), report(1, 2, 1, start_ns=6), report(1, 3, 2), report(1, 4, 3, start_ns=7)]
    for got in corrected(spark, rows):
        assert [got[1, i][0] for i in (1, 2, 3, 4)] == [5, 5, BASE_NS, BASE_NS]


def random_forest(rng, traces):
    rows = []
    for t in range(1, traces + 1):
        n = rng.randint(1, 40)
        order = list(range(2, n + 1))
        rng.shuffle(order)
        placed = [1]
        for i, s in enumerate([1, *order]):
            start = rng.choice([BASE_NS + rng.randint(0, 9999), rng.randint(1, 9999)])
            four = rng.random() < 0.4
            parent = 1 if s == 1 else (placed[-1] if rng.random() < 0.5 else rng.choice(placed))
            rows.append(report(
                t, s, parent, start_ns=start, duration_ns=rng.randint(1, 99),
                **{c: start + rng.randint(-50, 50) if four else 0 for c in ("cs", "cr", "ss", "sr")},
            ))
            placed.append(s)
        if rng.random() < 0.3:  # a cycle with a tail
            rows += [report(t, 901, 902, start_ns=3), report(t, 902, 901), report(t, 903, 902, start_ns=4)]
    return rows


def test_equals_recursion(spark):
    rows = random_forest(random.Random(3), 60)
    by_trace = {}
    for r in rows:
        by_trace.setdefault(r["trace_id"], []).append(r)
    want = {(t, s): v for t, spans in by_trace.items() for s, v in walk(spans, 1, 11).items()}
    for got in corrected(spark, rows, 11):
        assert got == want


def test_deepest_chain(spark):
    """8192 spans in a line, each 3 ns off: found by doubling, on one row and by joins."""
    base = merged_frame(spark, [report()]).drop("span_id", "parent_id", "start_ns", "cs", "cr", "ss", "sr")
    n = F.col("id")
    chain = spark.range(1, 8193).select(
        n.alias("span_id"), F.greatest(n - 1, F.lit(1)).alias("parent_id"),
        F.lit(BASE_NS).alias("start_ns"), F.lit(BASE_NS).alias("cs"), F.lit(BASE_NS + 10).alias("cr"),
        F.lit(BASE_NS - 3).alias("sr"), F.lit(BASE_NS + 7).alias("ss"),
    ).crossJoin(base).select(*merged_frame(spark, [report()]).columns)
    for fix in (correct_traces, correct_timings):
        off = F.max(F.abs(F.col("start_ns") - BASE_NS - 3 * (F.col("span_id") - 1)))
        assert fix(chain).agg(F.count("*"), off).first() == (8192, 0)


def test_outline(spark):
    rows = [report(1, 1, 1, name="a")] + [report(1, i, 1, name="k") for i in range(2, 40)]
    rows += [report(1, 100 + i, 1 if i == 0 else 99 + i, name="deep") for i in range(9)]
    lines = T.trace_outline(merged_frame(spark, rows)).orderBy("path").collect()
    assert lines[0].text.startswith("a [") and lines[1].span_id == 100
    assert [x.level for x in lines[:8]] == [0, 1, 2, 3, 4, 5, 6, 7] and lines[7].text == "[...]"
    assert lines[-1].text == "[... 7 more children]" and lines[-1].level == 1
    assert sum(x.level == 1 for x in lines) == 33


def test_outline_orders_signed_ids(spark):
    rows = [report(1, 5, 5), report(1, -9, 5), report(1, 9, 5), report(1, -2, 7), report(1, 8, 7)]
    lines = T.trace_outline(merged_frame(spark, rows)).orderBy("path").collect()
    assert [x.span_id for x in lines] == [8, 5, 9, -9, -2]


def test_too_large_traces_are_not_collected(spark):
    df = merged_frame(spark, [report(1, i + 1, 1) for i in range(6)] + [report(2, i + 1, 1) for i in range(5)])
    assert [r.trace_id for r in bounded(df, 5).select("trace_id").distinct().collect()] == [2]
    assert bounded(df, 6).count() == 11


@pytest.mark.parametrize("size", [2, 3, 64, 65, 127, 128, 129, 1000])
def test_long_traces_find_parents_as_joins_do(spark, size):
    """Around the size from which on ids are sorted, with parents that are the least, the greatest and missing."""
    rng = random.Random(size)
    names = [rng.getrandbits(63) - 2**62 for _ in range(size)]
    rows = [report(5, names[0], 0)] + [report(5, s, rng.choice(names[: i + 1])) for i, s in enumerate(names[1:])]
    rows += [report(6, s, rng.choice([min(names), max(names), 2**62 + 1])) for s in names]
    df = merged_frame(spark, rows)
    judged = {r.trace_id: r for r in judge_traces(collect_traces(df)).collect()}
    for trace in judged.values():
        at = {s.span_id: i + 1 for i, s in enumerate(trace.tree)}
        want = [0 if s.parent_id == s.span_id else at.get(s.parent_id, 0) for s in trace.tree]
        assert trace.ups == want
        assert trace.status == ("finished" if want.count(0) == 1 else "no_root")


def test_largest_traces_take_well_under_a_second(spark):
    """Spans of largest traces, each below a random earlier one."""
    i = F.col("id") % 8192
    base = merged_frame(spark, [report()]).drop("trace_id", "span_id", "parent_id")
    spans = base.crossJoin(spark.range(24 * 8192).withColumns({
        "trace_id": F.floor(F.col("id") / 8192) + 1, "span_id": F.xxhash64(i),
        "parent_id": F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.pmod(F.xxhash64(F.col("id"), F.lit(1)), i))),
    }).drop("id"))
    began = time.monotonic()
    statuses = judge_traces(collect_traces(spans.repartition(8, "trace_id"))).groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in statuses] == [("finished", 24)]
    assert time.monotonic() - began < 24
