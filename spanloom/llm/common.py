"""Tables, written steps and range pieces, shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schema import work_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of the rows that a worker gets at a time, unless one row is larger


def small_batches(spark: SparkSession) -> None:
    """Rows go to workers in batches bounded by bytes as well as by their number."""
    set_to = spark.conf.get(ARROW_BYTES, None)
    if set_to is None or not set_to.isdigit() or int(set_to) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_tasks(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """`df`, of at most so many rows, in tasks of about `per_task` rows where it has more tasks than that.

    For small steps of many rounds, which cost time by their tasks and files. What a task gets stays
    bounded, and the tasks grow with the rows up to those that the shuffle before made.
    """
    tasks = -(-rows // per_task)
    return df.coalesce(max(1, tasks)) if tasks < shuffle_partitions(df.sparkSession) else df


class Steps:
    """Written steps of one operator call, below the shared folder of the cluster.

    A step is a Parquet table: it outlives lost executors, cuts the lineage, and lets Spark
    drop the shuffle files that made it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, work_dir(spark), 0
        small_batches(spark)
        self.latest = ""  # folder of the step written last

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
        path, conf = self.path(name), self.spark.conf
        self.latest = path
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*partition_by).parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, folder: str) -> None:
        """Delete a written step, or a part of it, that nothing reads any more."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def range_borders(df: DataFrame, column: str, pieces: int, per_piece: int = 64) -> list[int]:
    """At most `pieces - 1` values that cut the distinct values of an integer column evenly.

    They are quantiles of a sample of at most `pieces * per_piece` values: those with the smallest
    hashes, so that the same table always gives the same borders. Only the column is read.
    """
    value = F.col(column).cast("bigint")
    sample = (
        df.select(value.alias("v")).filter("v is not null").distinct()
        .orderBy(F.xxhash64("v"), "v").limit(pieces * per_piece).collect()
    )
    values = sorted(r.v for r in sample)
    return values[max(1, -(-len(values) // pieces)) :: max(1, -(-len(values) // pieces))]


def range_piece(borders: list[int], value: Column) -> Column:
    """The number, from 0, of the range that a value falls into; null goes to 0."""
    if not borders:
        return F.lit(0)
    reached = F.filter(F.lit(borders).cast("array<bigint>"), lambda border: border <= value)
    return F.when(value.isNull(), 0).otherwise(F.size(reached))
