"""The span record, the raw payload record and the session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and texts the results depend on.
MAX_TRACE_SPANS = 8192
MAX_OPEN_SPANS = 100_000
BLACKLIST_SIZE = 1023
AGE_FACTOR = 5
GAP_STEPS = [(0, 8), (40_000, 6), (60_000, 4), (80_000, 2)]  # open spans -> seconds
FIRST_PLAUSIBLE_NS = 1_577_836_800_000 * 1_000_000  # 2020-01-01
FAKE_ROOT = "fake-root"
PROTOCOL_TAG = "protocolVersion"
PROTOCOL_TEXT = {"json-v1": "json v1", "json-v2": "json v2", "jaeger": "jaeger"}

TIMINGS = ["cs", "cr", "ss", "sr"]

# One report of a span. Zero and '' stand for "absent"; there are no nulls.
SPAN = """
    trace_id BIGINT, span_id BIGINT, parent_id BIGINT,
    name STRING, service STRING,
    start_ns BIGINT, duration_ns BIGINT,
    cs BIGINT, cr BIGINT, ss BIGINT, sr BIGINT,
    tags MAP<STRING, STRING>,
    received_at TIMESTAMP, payload_id BIGINT, pos BIGINT
"""
SPAN_COLUMNS = [
    "trace_id", "span_id", "parent_id", "name", "service", "start_ns", "duration_ns",
    "cs", "cr", "ss", "sr", "tags", "received_at", "payload_id", "pos",
]

# One payload as it came in. `protocol` is json-v1, json-v2 or jaeger.
RAW = """
    payload_id BIGINT, received_at TIMESTAMP, protocol STRING,
    content_type STRING, body STRING
"""

TRACE = ["trace_id", "session_no"]


def arrival_order() -> Column:
    """Total arrival order of reports; replayable, needs no global row number."""
    return F.struct("received_at", "payload_id", "pos")


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on. All of them are runtime settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Hot keys in row-level joins are split at run time, also where that costs a shuffle.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # A key repeated in a JSON object: the last one wins, instead of failing the value.
        "spark.sql.variant.allowDuplicateKeys": "true",
        # The JVM never compiles a method of more bytes: such a stage is faster as one method per operator.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Of a ranked top list up to this long each task keeps only so many rows before the shuffle.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spanloom-")
    return f"{shared.rstrip('/')}/spanloom-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is in the store that its path names."""
    store, where = _store(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; a missing folder holds nothing."""
    store, where = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    store, where = _store(spark, path)
    store.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder; in a file system this is one step."""
    store, where = _store(spark, path)
    if not store.rename(where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")


def cut_lineage(df: DataFrame, path: str) -> DataFrame:
    """Write a step of an iterative job as a table and go on from the table.

    The files outlive lost executors, and the plan of the next step starts at a scan.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
