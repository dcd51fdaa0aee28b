"""Literal spans for tests, and the rules written as plain loops to compare with."""

from datetime import datetime, timedelta, timezone

from spanloom.schema import FIRST_PLAUSIBLE_NS, SPAN

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE_NS = 1_704_067_200 * 1_000_000_000


def report(trace=1, span=1, parent=0, at=0.0, **fields):
    row = {
        "trace_id": trace, "span_id": span, "parent_id": parent, "name": "", "service": "",
        "start_ns": BASE_NS, "duration_ns": 1000, "cs": 0, "cr": 0, "ss": 0, "sr": 0, "tags": {},
        "received_at": EPOCH + timedelta(seconds=at), "payload_id": 0, "pos": 0,
    }
    row.update(fields)
    return row


def frame(spark, rows, **extra):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple(r.values()) for r in rows], SPAN)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value).cast("bigint"))
    return df


def merged_frame(spark, rows):
    """Spans as merge_spans leaves them, one session."""
    from pyspark.sql import functions as F

    return (
        frame(spark, rows, session_no=1)
        .withColumn("last_at", F.col("received_at"))
        .withColumn("reports", F.lit(1).cast("bigint"))
    )


def fold_in_order(reports):
    """The merge as a loop over reports in arrival order."""
    out = dict(reports[0], tags=dict(reports[0]["tags"]))
    for new in reports[1:]:
        if out["parent_id"] == 0:
            out["parent_id"] = new["parent_id"]
        if new["sr"] > 0 or new["ss"] > 0:
            for f in ("service", "name"):
                out[f] = new[f] if new[f] else out[f]
            out["tags"].update(new["tags"])
            for f in ("sr", "ss"):
                out[f] = new[f] if new[f] > 0 else out[f]
        else:
            for f in ("service", "name"):
                out[f] = out[f] if out[f] else new[f]
            out["tags"] = {**new["tags"], **out["tags"]}
            for f in ("cs", "cr"):
                out[f] = new[f] if new[f] > 0 else out[f]
    return out


def walk(spans, root_id, offset=0):
    """Corrected (start, duration) per span id, by recursion from the root."""
    result = {s["span_id"]: (s["start_ns"], s["duration_ns"]) for s in spans}
    by_id = {s["span_id"]: s for s in spans}

    def half(x):
        return int(x / 2) if abs(x) < 2**52 else (x // 2 if x >= 0 else -(-x // 2))

    todo = [(root_id, None, offset)]
    while todo:
        span_id, parent_start, shift = todo.pop()
        s = by_id[span_id]
        start, length = s["start_ns"] + shift, s["duration_ns"]
        if s["cs"] and s["cr"] and s["ss"] and s["sr"]:
            start, length = s["cs"] + shift, s["cr"] - s["cs"]
            shift += half(s["cr"] + s["cs"]) - half(s["sr"] + s["ss"])
        if parent_start is not None and start < FIRST_PLAUSIBLE_NS:
            start = parent_start
        result[span_id] = (start, length)
        todo += [
            (c["span_id"], start, shift) for c in spans
            if c["parent_id"] == span_id and c["span_id"] != c["parent_id"]
        ]
    return result
