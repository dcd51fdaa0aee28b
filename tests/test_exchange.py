"""The append-only exchange: positions of readers, retention, appends that end half-way."""

import pytest

from spanloom.schema import remove
from spanloom.sources import sharded
from tests.spans import frame, report

NOW = 1_704_067_200_000_000


def ids(df):
    return sorted((r.sequence, r.span_id) for r in df.collect())


def test_two_readers_and_a_sweep(spark, tmp_path):
    x = sharded.Exchange(spark, str(tmp_path / "x"), 3)
    assert x.append(frame(spark, [report(1, 1), report(2, 2)])) == 1
    fast, at = x.poll("fast")
    assert ids(fast) == [(1, 1), (1, 2)] and at == 1
    x.store("fast", at)
    x.poll("slow")  # known from now on, but it stores nothing
    assert x.append(frame(spark, [report(1, 3, at=60)])) == 2
    fast, at = x.poll("fast")
    assert ids(fast) == [(2, 3)] and x.sweep(NOW + 10**12) == []  # the slow one holds it all
    x.store("fast", at)
    slow, at = x.poll("slow")
    assert ids(slow) == [(1, 1), (1, 2), (2, 3)]
    x.store("slow", 1)
    assert x.sweep(NOW + 10**12) == [1] and x.sequences() == [2]
    x.store("slow", 2)
    assert x.sweep(NOW + 659_000_000) == []  # not older than ten minutes yet
    assert x.sweep(NOW + 661_000_000) == [2] and x.sequences() == []
    assert x.append(frame(spark, [report(5, 5)])) == 3  # numbers are not used again
    assert ids(x.poll("fast")[0]) == ids(x.poll("slow")[0]) == [(3, 5)]
    assert ids(x.poll("new")[0]) == [(3, 5)]
    assert [x.poll("fast", [s])[0].count() for s in range(3)].count(1) == 1


def test_empty_exchange_and_empty_appends(spark, tmp_path):
    x = sharded.Exchange(spark, str(tmp_path / "x"))
    assert x.poll("a")[0].count() == 0 and x.poll("a")[1] == 0 and x.sweep(NOW) == []
    assert x.append(frame(spark, [])) == 1
    spans, at = x.poll("a")
    assert spans.count() == 0 and at == 1


@pytest.mark.parametrize("moved", [False, True])
def test_append_that_ended_half_way(spark, tmp_path, moved):
    """Killed before the move: written anew. Killed before the log: what was moved stays."""
    x = sharded.Exchange(spark, str(tmp_path / "x"))
    df = frame(spark, [report(1, 1), report(2, 2)])
    if moved:
        x.append(df, 1)
        remove(spark, f"{x.path}/_log/sequence=1")
    else:
        sharded.write_sharded(frame(spark, [report(9, 9)]), f"{x.path}/_pending-1")
        assert x.sequences() == []
    for _ in range(2):
        assert x.append(df, 1) == 1
    assert ids(x.poll("a")[0]) == [(1, 1), (1, 2)]
