import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import merge as M
from tests.spans import EPOCH, fold_in_order, frame, report

FOLDS = [M.merge_spans, M.fold_lists, M.combine_reports]
FIELDS = ["parent_id", "name", "service", "start_ns", "duration_ns", "cs", "cr", "ss", "sr", "tags"]


def test_valid_spans(spark):
    df = frame(spark, [report(0, 1), report(1, 0), report(1, 1), report(-1, -1)])
    assert M.valid_spans(df).count() == 2


@pytest.mark.parametrize("fold", FOLDS)
def test_timings_and_tags(spark, fold):
    rows = [
        report(1, at=0, cs=1), report(1, at=1, ss=2),
        report(2, at=0, tags={"tag": "a"}), report(2, at=1, tags={"tag": "b"}),
        report(3, at=0, tags={"tag": "a"}), report(3, at=1, sr=1, tags={"tag": "b"}),
    ]
    got = {r.trace_id: r for r in fold(frame(spark, rows, session_no=1)).collect()}
    assert (got[1].cs, got[1].ss, got[1].reports) == (1, 2, 2)
    assert got[2].tags == {"tag": "a"} and got[3].tags == {"tag": "b"}


def random_reports(rng, groups):
    rows = []
    for g in range(1, groups + 1):
        for i in range(rng.randint(1, 5)):
            pick = lambda: rng.choice([0, 0, rng.randint(1, 9), -3])
            rows.append(
                report(
                    g, 7, rng.choice([0, 0, 1, 2]), at=rng.randint(0, 3), payload_id=i, pos=rng.randint(0, 9),
                    name=rng.choice(["", "x", "y", "z"]), service=rng.choice(["", "p", "q"]),
                    cs=pick(), cr=pick(), ss=pick(), sr=pick(), start_ns=rng.randint(1, 99),
                    tags={k: str(rng.randint(0, 9)) for k in "abc" if rng.random() < 0.5},
                )
            )
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fold", FOLDS)
def test_equals_ordered_fold(spark, fold):
    rows = random_reports(random.Random(5), 400)
    got = {r.trace_id: r for r in fold(frame(spark, rows, session_no=1)).collect()}
    for g in got:
        own = sorted(
            (r for r in rows if r["trace_id"] == g), key=lambda r: (r["received_at"], r["payload_id"], r["pos"])
        )
        want = fold_in_order(own)
        assert {f: got[g][f] for f in FIELDS} == {f: want[f] for f in FIELDS}
        assert got[g].reports == len(own) and got[g].last_at.timestamp() == own[-1]["received_at"].timestamp()


def test_merged_spans_merge_on_with_later_reports(spark):
    rows = random_reports(random.Random(6), 60)
    df = frame(spark, rows, session_no=1)
    columns = [*df.columns, "reports", "last_at"]
    early = F.col("received_at") < F.lit(EPOCH + timedelta(seconds=2))
    later = df.filter(~early).withColumns({"reports": F.lit(1).cast("bigint"), "last_at": F.col("received_at")})
    both = M.merge_spans(df.filter(early)).select(*columns).unionByName(later.select(*columns))
    by_trace = lambda d: sorted(d.collect(), key=lambda r: r.trace_id)
    assert by_trace(M.merge_spans(both)) == by_trace(M.merge_spans(df))


@pytest.mark.parametrize("few, ids", [(1, 50_000), (2, 50_000), (2, 3)])
def test_spans_with_many_reports_are_combined(spark, monkeypatch, few, ids):
    """Both folds in one result, with ids of spans with many reports broadcast and joined."""
    monkeypatch.setattr(M, "FEW_REPORTS", few)
    monkeypatch.setattr(M, "BROADCAST_IDS", ids)
    df = frame(spark, random_reports(random.Random(7), 80), session_no=1)
    by_trace = lambda d: sorted(d.collect(), key=lambda r: r.trace_id)
    merged = M.merge_spans(df)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (ids == 50_000) and "ShuffledHashJoin" not in plan or ids == 3
    assert by_trace(merged) == by_trace(M.combine_reports(df))


@pytest.mark.parametrize("few", [64, 1])
def test_some_columns_are_as_in_the_whole_fold(spark, monkeypatch, few):
    """Also where spans with many reports are combined."""
    monkeypatch.setattr(M, "FEW_REPORTS", few)
    df = frame(spark, random_reports(random.Random(5), 60), session_no=1)
    for columns in (["name", "last_at"], ["parent_id", "start_ns"], ["tags", "ss"], ["cr", "reports"]):
        keys = ["trace_id", "span_id"]
        got, want = M.merge_spans(df, columns=columns), M.merge_spans(df).select(*keys, "session_no", *columns)
        flat = lambda d: sorted(str(r.asDict()) for r in d.select(*keys, *columns).collect())
        assert flat(got) == flat(want)


def test_no_sort_of_rows_by_tag(spark):
    """Without a span with many reports there is one shuffle and no row per tag."""
    plan = M.merge_spans(frame(spark, random_reports(random.Random(8), 20), session_no=1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan


def test_spans_of_a_large_trace_are_counted(spark, monkeypatch):
    """Some spans of a trace with many reports have many, those of the others have few."""
    rows = [report(1, 1, at=i, tags={"n": str(i)}) for i in range(6)] + [report(1, 2), report(2, 1), report(2, 2, at=3)]
    df = frame(spark, rows, session_no=1)
    monkeypatch.setattr(M, "FEW_REPORTS", 2)
    combined, real = [], M.combine_reports
    monkeypatch.setattr(M, "combine_reports", lambda some, keys: combined.append(some) or real(some, keys))
    got = {(r.trace_id, r.span_id): r.reports for r in M.merge_spans(df).collect()}
    assert got == {(1, 1): 6, (1, 2): 1, (2, 1): 1, (2, 2): 1}
    assert combined[0].count() == 6
    monkeypatch.setattr(M, "BROADCAST_IDS", 0)
    assert {(r.trace_id, r.span_id): r.reports for r in M.merge_spans(df).collect()} == got
