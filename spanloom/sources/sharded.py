"""Span tables sharded by trace id (S6): what a partitioned topic is to separate services.

`write_sharded` makes one table. `Exchange` is a table that is appended to: each append is a
sequence number, readers go on from the number they stored, and what is old enough is deleted once
every reader has passed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schema import SPAN, children, cut_lineage, exists, remove, rename

SHARDS = 12  # fixed value: partitions of the topic
RETENTION_US = 600_000_000  # fixed value: ten minutes
PRECISE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}  # arrivals order reports by microsecond


def shard_of(trace_id: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(trace_id), F.lit(shards))


def write_sharded(
    df: DataFrame, path: str, shards: int = SHARDS, max_records: int = 5_000_000
) -> None:
    """Parquet folders per shard, so a reader of one shard sees whole traces.

    Adaptive execution splits a shard over as many tasks as its size asks for, so neither the
    number of shards nor a trace that holds much of the data limits how many tasks write.
    """
    sharded = df.withColumn("shard", shard_of(F.col("trace_id"), shards))
    spread = sharded.hint("rebalance", F.col("shard"))
    spread.write.mode("overwrite").partitionBy("shard").option(
        "maxRecordsPerFile", max_records
    ).parquet(path)


def read_sharded(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    df = spark.read.schema(f"{SPAN}, shard INT").parquet(path)
    return df if shards is None else df.filter(F.col("shard").isin(shards))


def stream_sharded(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(f"{SPAN}, shard INT").option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def to_topic_records(df: DataFrame) -> DataFrame:
    """(key, value) records for a message topic; the key makes traces stay together.

    Write with `.write.format("kafka")` where that connector is on the class path.
    """
    return df.select(
        F.col("trace_id").cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*[c for c in df.columns if c != "shard"]), PRECISE).cast("binary").alias("value"),
    )


def from_topic_records(records: DataFrame) -> DataFrame:
    """Spans of topic records; records that cannot be decoded are skipped."""
    span = F.from_json(F.col("value").cast("string"), SPAN, PRECISE)
    return (
        records.select(F.explode(F.array(span)).alias("s"))
        .filter(F.col("s.trace_id").isNotNull() & F.col("s.span_id").isNotNull())
        .select("s.*")
    )


class Exchange:
    """Append-only shards of spans with reader positions and retention, below one folder.

    An append becomes visible as a whole: it is written aside and moved to `sequence=N`. One writer
    appends at a time; any number of readers read. A sequence number is never used again, also after
    its files are gone.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path, self.shards = spark, path, shards

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        names = children(self.spark, folder)
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def sequences(self) -> list[int]:
        """The numbers whose spans can be read."""
        return self._numbers(self.path, "sequence=")

    def last(self) -> int:
        """The latest number that was appended, 0 if none."""
        return max([0, *self._numbers(f"{self.path}/_log", "sequence=")])

    def append(self, spans: DataFrame, number: int | None = None) -> int:
        """Adds spans under the next number and returns it. A stream gives its batch id plus 1 as the
        `number`: appending a number again does nothing."""
        number = self.last() + 1 if number is None else number
        if exists(self.spark, f"{self.path}/_log/sequence={number}/_SUCCESS"):
            return number
        pending, final = f"{self.path}/_pending-{number}", f"{self.path}/sequence={number}"
        if not exists(self.spark, final):
            write_sharded(spans, pending, self.shards)
            rename(self.spark, pending, final)
        newest = self._read([number]).agg(F.max(F.unix_micros("received_at")).alias("newest_us"))
        cut_lineage(newest, f"{self.path}/_log/sequence={number}")
        return number

    def _read(self, numbers: list[int]) -> DataFrame:
        reader = self.spark.read.schema(f"{SPAN}, sequence BIGINT, shard INT").option("basePath", self.path)
        if not numbers:
            return self.spark.createDataFrame([], f"{SPAN}, sequence BIGINT, shard INT")
        return reader.parquet(*[f"{self.path}/sequence={n}" for n in numbers])

    def _latest(self, reader: str) -> int | None:
        at = self._numbers(f"{self.path}/_readers/{reader}", "at=")
        done = [n for n in at if exists(self.spark, f"{self.path}/_readers/{reader}/at={n}/_SUCCESS")]
        return max(done) if done else None

    def position(self, reader: str) -> int:
        """The last number that a reader has stored; 0 for a new one."""
        return self._latest(reader) or 0

    def poll(self, reader: str, shards: list[int] | None = None) -> tuple[DataFrame, int]:
        """What came after a reader's position, and the position to store once it is worked off.

        A reader is known, and holds back the retention, from its first poll on.
        """
        if self._latest(reader) is None:
            self.store(reader, 0)
        at = self.position(reader)
        numbers = [n for n in self.sequences() if n > at]
        spans = self._read(numbers)
        return spans if shards is None else spans.filter(F.col("shard").isin(shards)), max([at, *numbers])

    def store(self, reader: str, position: int) -> None:
        """Positions are folders of their own, so a position is stored in one step and never half."""
        folder = f"{self.path}/_readers/{reader}"
        before = self._numbers(folder, "at=")
        cut_lineage(self.spark.range(1), f"{folder}/at={position}")
        for old in before:
            if old < position:
                remove(self.spark, f"{folder}/at={old}")

    def sweep(self, now_us: int, retention_us: int = RETENTION_US) -> list[int]:
        """Deletes the numbers whose latest arrival is older than the retention and that every known
        reader has passed; returns them. Empty appends go with the first sweep behind all readers."""
        readers = children(self.spark, f"{self.path}/_readers")
        passed = min([self.position(r) for r in readers], default=self.last())
        numbers = [n for n in self.sequences() if n <= passed]
        if not numbers:
            return []
        log = self.spark.read.schema("newest_us BIGINT, sequence BIGINT").parquet(f"{self.path}/_log")
        old = log.filter(F.col("sequence").isin(numbers) & (F.coalesce("newest_us", F.lit(0)) < now_us - retention_us))
        gone = sorted(r.sequence for r in old.select("sequence").collect())  # one row per append since the last sweep
        for number in gone:
            remove(self.spark, f"{self.path}/sequence={number}")
        return gone
