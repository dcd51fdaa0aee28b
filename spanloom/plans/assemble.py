"""The whole batch plan: reports to corrected spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.merge import MERGED_COLUMNS, combine_reports, fold_lists, valid_spans
from spanloom.operators.output import convert
from spanloom.operators.sessions import (
    FEW_ARRIVALS, closed_spans, closed_together, count_arrivals, session_outcomes, split_by_id,
)
from spanloom.operators.traces import collect_traces, finish_traces, judge_traces
from spanloom.schema import MAX_TRACE_SPANS, TRACE

# Arrivals of a trace that may be one list in memory; both ways give the same result.
LIST_LIMIT = 4 * MAX_TRACE_SPANS


def assemble_traces(
    reports: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS, columns: Sequence[str] = MERGED_COLUMNS,
) -> DataFrame:
    """Reports to one row per closed trace, judged.

    Only `columns` are folded, beside the ids; the others are not shuffled either (see collect_traces).

    Arrivals are counted per trace id first. Trace ids with few are brought to one task each, which finds their sessions
    and merges and collects their traces: that is the only wide shuffle. For the others, and where all is one task's,
    there are two: one that assigns sessions and drops bad traces, keyed by trace id and time
    bucket, and one that brings a trace together, keyed by trace id and session. Traces with
    few arrivals merge inside the second; those with very many arrivals of few ids merge
    before it, combined on the map side.
    """
    valid = valid_spans(reports)
    ids, tasks = count_arrivals(valid)
    if tasks > 1 and ids is not None and max_spans >= FEW_ARRIVALS:
        some, valid = split_by_id(valid, ids) if ids else (valid, None)
        # closed_us belongs to the trace, so it may be a key as well and comes along for free.
        merged = fold_lists(closed_together(some, gap_us, tasks), [*TRACE, "closed_us"], columns)
        small = judge_traces(collect_traces(merged))
        return small if valid is None else small.unionByName(_assemble_spread(valid, gap_us, max_spans, columns))
    return _assemble_spread(valid, gap_us, max_spans, columns)


def _assemble_spread(valid: DataFrame, gap_us: int, max_spans: int, columns: Sequence[str]) -> DataFrame:
    """The same for trace ids with any number of arrivals."""
    closed = closed_spans(valid, gap_us, max_spans)
    # What nobody wants is nothing behind that join, so that both ways of merging read the same columns of one shuffle.
    absent = {"name": F.lit(""), "service": F.lit(""), "tags": F.create_map().cast("map<string,string>")}
    closed = closed.withColumns({c: nothing for c, nothing in absent.items() if c not in columns})
    few = closed.filter(F.col("arrivals") <= LIST_LIMIT)
    many = closed.filter(F.col("arrivals") > LIST_LIMIT)
    keys = [*TRACE, "closed_us"]
    together = fold_lists(few.repartition(*[F.col(c) for c in TRACE]), keys, columns)
    hot = combine_reports(many, keys).select(*keys, "span_id", *columns)
    traces = collect_traces(together).unionByName(collect_traces(hot))
    return judge_traces(traces)


def correct_spans(
    reports: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS,
    hook: Callable[[DataFrame], DataFrame] = lambda df: df, columns: Sequence[str] = MERGED_COLUMNS,
) -> DataFrame:
    """Corrected spans of all traces with a unique root, through the user's hook.

    Of the columns of a merged span only `columns` are made; parents and times must be among them.
    """
    return convert(finish_traces(assemble_traces(reports, gap_us, max_spans, columns)), hook)


def trace_outcomes(
    reports: DataFrame, gap_us: int, max_spans: int = MAX_TRACE_SPANS
) -> DataFrame:
    """Every trace with its final status: finished, no_root, too_large, too_old, blacklisted.

    No span is merged for it: only ids, parents and arrival times are read and shuffled.
    """
    return session_outcomes(valid_spans(reports), gap_us, max_spans)
