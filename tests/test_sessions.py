import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import sessions as S
from tests.spans import frame, report

GAP = 8_000_000


def numbers(spark, *times):
    rows = [report(1, i + 1, at=t) for i, t in enumerate(times)]
    got = S.sessionize(frame(spark, rows), GAP).orderBy("span_id").collect()
    return [r.session_no for r in got]


def test_gap_is_exact(spark):
    assert numbers(spark, 0, 8, 15.999) == [1, 2, 2]
    assert numbers(spark, 0, 7.999, 15.998) == [1, 1, 1]


def statuses(spark, rows, max_spans=8192):
    got = S.classify_sessions(frame(spark, rows), GAP, max_spans).orderBy("trace_id", "session_no")
    return [r.status for r in got.collect()]


def test_age(spark):
    assert statuses(spark, [report(1, i, at=7 * i) for i in range(1, 7)]) == ["too_old"]
    assert statuses(spark, [report(1, i, at=t) for i, t in enumerate((0, 7, 14, 21, 28, 32), 1)]) == ["closed"]


def test_size(spark):
    rows = [report(1, i % 4 + 1, at=i / 10) for i in range(12)] + [report(2, i, at=0) for i in range(1, 6)]
    assert statuses(spark, rows, max_spans=4) == ["closed", "too_large"]


def test_real_size_limit(spark):
    one = F.lit(0).cast("bigint")
    base = frame(spark, [report()]).drop("trace_id", "span_id")
    ids = spark.range(1, 8194).select(one.alias("trace_id"), F.col("id").alias("span_id"))
    traces = ids.withColumn("trace_id", F.lit(1).cast("bigint")).unionByName(
        ids.select(F.lit(2).cast("bigint").alias("trace_id"), F.least("span_id", F.lit(8192)).alias("span_id"))
    )
    got = S.classify_sessions(traces.crossJoin(base), GAP).orderBy("trace_id").collect()
    assert [(r.status, r.arrivals) for r in got] == [("too_large", 8193), ("closed", 8193)]


def test_large_beats_old_only_in_time(spark):
    early = [report(1, i, at=i) for i in range(1, 7)] + [report(1, 9, at=7 * i) for i in range(1, 8)]
    late = [report(2, 1, at=7 * i) for i in range(8)] + [report(2, i, at=49) for i in range(2, 9)]
    assert statuses(spark, early + late, max_spans=5) == ["too_large", "too_old"]


def test_blacklist_takes_later_sessions(spark):
    rows = [report(1, 1, at=0)] + [report(1, i, at=100 + 7 * i) for i in range(1, 8)]
    rows += [report(1, 1, at=1000), report(1, 2, at=2000), report(2, 1, at=1000)]
    assert statuses(spark, rows) == ["closed", "too_old", "blacklisted", "blacklisted", "closed"]
    judged = S.classify_sessions(frame(spark, rows), GAP)
    listed = S.blacklist(judged)
    assert [r.trace_id for r in listed.collect()] == [1]
    assert S.apply_blacklist(frame(spark, rows), listed).count() == 1
    closed = S.closed_spans(frame(spark, rows), GAP).collect()
    assert sorted((r.trace_id, r.session_no) for r in closed) == [(1, 1), (2, 1)]


def test_cap_blacklist_keeps_newest(spark):
    listed = spark.range(1, 2001).select(F.col("id").alias("trace_id"), (F.col("id") % 100).alias("since_us"))
    kept = S.cap_blacklist(listed)
    assert kept.count() == 1023 and kept.agg(F.min("since_us")).first()[0] == 48


def ticked(arrivals, gap, limit, step=0.5):
    """The assembler as a clocked loop over one trace id."""
    out, open_, listed, t, i = [], None, False, 0.0, 0
    while i < len(arrivals) or open_:
        while i < len(arrivals) and arrivals[i][0] <= t:
            at, span = arrivals[i]
            i += 1
            if listed:
                continue
            open_ = open_ or {"start": at, "ids": set(), "n": 0}
            open_["last"] = at
            open_["ids"].add(span)
            open_["n"] += 1
        if open_:
            if len(open_["ids"]) > limit:
                out.append(("too_large", None))
            elif open_["start"] < t - 5 * gap:
                out.append(("too_old", None))
            elif open_["last"] <= t - gap:
                out.append(("closed", open_["n"]))
            else:
                t += step
                continue
            listed = listed or out[-1][0] != "closed"
            open_ = None
        t += step
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_clocked_assembler(spark, seed):
    """Arrivals lie on the clock's grid, so the loop sees each exactly on time."""
    rng, rows, want = random.Random(seed), [], {}
    for trace in range(1, 120):
        t, arrivals = 0.0, []
        for _ in range(rng.randint(1, 16)):
            t += rng.choice([0.5, 1.0, 2.0, 3.0, 3.5, 4.5, 9.0])
            arrivals.append((t, rng.randint(1, 8)))
        rows += [report(trace, s, at=at, pos=i) for i, (at, s) in enumerate(arrivals)]
        want[trace] = ticked(arrivals, 4.0, 6)
    judged = S.classify_sessions(frame(spark, rows), 4_000_000, 6).orderBy("trace_id", "session_no")
    got = {}
    for r in judged.collect():
        if r.status != "blacklisted":
            got.setdefault(r.trace_id, []).append((r.status, r.arrivals if r.status == "closed" else None))
    assert got == want


def test_arrivals_after_the_age_limit_count_as_blacklisted(spark):
    from spanloom.operators.metrics import span_metrics

    rows = [report(1, i + 1, 1, at=7 * i) for i in range(30)] + [report(1, 99, at=500)]
    rows += [report(2, 1, 1), report(2, 1, 1, at=1), report(2, 2, 1)]
    outcomes = S.session_outcomes(frame(spark, rows), 8_000_000)
    got = {(r.trace_id, r.session_no): (r.status, r.node_count, r.arrivals, r.late) for r in outcomes.collect()}
    assert got == {(1, 1): ("too_old", 6, 30, 24), (1, 2): ("blacklisted", 1, 1, 0), (2, 1): ("finished", 2, 3, 0)}
    counts = span_metrics(outcomes).first().asDict()
    assert counts == {"merged_reports": 1, "spans": 2, "blacklisted": 25, "dropped": 6}


def test_outcomes_of_odd_trees(spark):
    trees = {
        1: [(1, 1), (2, 1)],  # own parent
        2: [(5, 9), (6, 9)],  # one missing parent: a fake root
        3: [(5, 8), (6, 9)],  # two missing parents
        4: [(1, 2), (2, 1)],  # a circle
        5: [(1, 0), (2, 0)],  # unknown parents: the fake root has id 0
        6: [(6, 7), (5, 7)],  # the fake root's parent is span 6, so it is none
        7: [(1, 7), (2, 7)],  # the fake root is its own parent
        8: [(1, 1), (2, 2)],
    }
    rows = [report(t, s, p) for t, spans in trees.items() for s, p in spans]
    got = {r.trace_id: r.status for r in S.session_outcomes(frame(spark, rows), 8_000_000).collect()}
    wrong = {3, 4, 6, 8}
    assert got == {t: "no_root" if t in wrong else "finished" for t in trees}
    from spanloom.operators.merge import merge_spans
    from spanloom.operators.traces import collect_traces, judge_traces

    merged = merge_spans(frame(spark, rows, session_no=1))
    assert got == {r.trace_id: r.status for r in judge_traces(collect_traces(merged)).collect()}


def test_outcomes_are_the_same_however_arrivals_are_brought_together(spark, monkeypatch):
    rng = random.Random(11)
    rows = [
        report(rng.randrange(1, 9), rng.randrange(1, 6), rng.randrange(6), at=rng.randrange(200) / 2, payload_id=i)
        for i in range(120)
    ]
    rows += [report(1, 3, received_at=None), report(9, 1, received_at=None), report(10, 1, at=1), report(None, 1, at=1)]
    df = frame(spark, rows)

    def outcomes():
        return sorted(map(tuple, S.session_outcomes(df, GAP, 4).collect()))

    together = outcomes()
    assert {r[0] for r in together} == {*range(1, 9), 10}
    for few, most in ((15, 50_000), (0, 50_000), (15, 1)):  # some, all and too many to be told
        monkeypatch.setattr(S, "FEW_ARRIVALS", few)
        monkeypatch.setattr(S, "BROADCAST_IDS", most)
        assert outcomes() == together
