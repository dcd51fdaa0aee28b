"""Each operator of this folder as a query over its whole test table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    chat, decontaminate, fingerprints, hard_negatives, jaccard, lexical, licences, packing, suffixes, toxicity, urls, vector_file,
)
from spanloom.llm.common import Steps, table
from spanloom.llm.warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]


def document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf, "documents"))


def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf, "documents"))


def long_repeats(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf, "documents"), F.col("doc_id"))
    return cut.select(F.col("row").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


TRICKY = r"\### Assistant: </turn> ok"


def chat_events(rows: DataFrame) -> DataFrame:
    """Rows as logs of events that fold back to them, in the order of turns: a text that streams in two parts,
    of which the second is delivered twice, one that an edit puts right, or one that is generated anew after
    a wrong start. A row without a turn is one event."""
    text, seq = F.coalesce("text", F.lit("")), F.col("turn").cast("bigint") * 8
    half = F.floor(F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    wrong = F.concat(F.lit("wrong "), F.reverse(text))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[
            F.struct((seq + i).alias("seq"), F.lit(kind).alias("kind"), (F.lit(None) if i else F.col("role")).cast("string").alias("role"),
                     part.alias("text"))
            for i, (kind, part) in enumerate(events)
        ])

    streamed = log(("message", head), ("delta", tail))
    streamed = F.concat(streamed, F.slice(streamed, 2, 1))
    edited = log(("message", wrong), ("delta", head), ("edit", text))
    anew = log(("message", wrong), ("delta", tail), ("regenerate", head), ("delta", tail))
    way = F.pmod(F.xxhash64("turn", "text"), F.lit(3))
    told = F.when(seq.isNull(), log(("message", text))).when(way == 0, streamed).when(way == 1, edited).otherwise(anew)
    return rows.withColumn("message_id", F.monotonically_increasing_id()).select("conv_id", "message_id", F.inline(told))


def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Each row of `conversations` as a message out of streamed, edited or regenerated parts."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return chat.read_back(chat.render(chat.fold_events(chat_events(rows.unionByName(added)))))


def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A URL ends in the id of the document its page shows; that document's label is its label."""
    pages, labels = table(spark, sf, "pages"), table(spark, sf, "labels")
    doc_id = F.regexp_extract("url", r"/(\d{1,18})[^/]*/?$", 1).try_cast("bigint")
    labelled = pages.select("url", doc_id.alias("doc_id")).join(labels, "doc_id").select(
        "url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    )
    return urls.judge_urls(pages, labelled)


def licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf, "documents"))


def benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def toxic_severity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def packed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    folder = Steps(spark).path("archive")
    write_warc(table(spark, sf, "pages"), folder)
    records = read_warc(spark, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def ranked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def mined_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth row is an anchor; labels of every seventh row are moved on by one."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), vec_id % 100 == 0, moved)


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth row asks."""
    return vector_file.top_inner(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Query] = {
    "op1_fingerprints": document_fingerprints,
    "op2_chat": chat_format,
    "op3_jaccard_join": similar_documents,
    "op4_urls": url_verdicts,
    "op5_suffix_dedup": long_repeats,
    "op6_licences": licence_scan,
    "op7_decontamination": benchmark_leaks,
    "op8_toxicity": toxic_severity,
    "op9_packing": packed_batches,
    "op10_warc": warc_archives,
    "op11_lexical_search": ranked_documents,
    "op12_hard_negatives": mined_negatives,
    "op13_vector_search": nearest_vectors,
}
