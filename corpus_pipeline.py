"""From raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Its result
is written as Parquet in the shared folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import Steps, table
from spanloom.llm.decontaminate import drop_leaks
from spanloom.llm.jaccard import drop_similar
from spanloom.llm.packing import pack
from spanloom.llm.suffixes import drop_repeats
from spanloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays."""
    return drop_similar(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long strings that occur earlier go."""
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for each sequence."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination), ("packing", packing),
]
# The stages are trained, randomised or optimising; SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the documents of a folder of tables."""
    docs, steps = table(spark, sf_dir, "documents"), Steps(spark)
    for name, stage in STAGES:
        docs = steps.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
