"""Document fingerprints: the k smallest hashes of a text's word shingles.

Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles. A text of under k shingles has an exact sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import range_borders, range_piece, shuffle_partitions
from spanloom.llm.tokens import shingle_sets

SIZE = 128
SHINGLE = 5  # words
SALTS = 64
ROWS = 2000  # texts that are sketched at a time

PAIR = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles double, in_edited double"
)


def text_of(sketch: np.ndarray) -> str:
    """The sketch as text: base64 of its hashes, smallest first, 8 bytes each."""
    return base64.b64encode(sketch.astype(">i8").tobytes()).decode()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">i8").astype(np.int64)


def merged(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the joint sketch that both have; two empty sketches are alike."""
    joint = merged(a, b, size)
    return len(np.intersect1d(np.intersect1d(joint, a), b)) / len(joint) if len(joint) else 1.0


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of a's shingles that b has, among those below the last hash of each full sketch.

    An empty sketch is contained in all; 0 where b's sketch ends before a's first hash.
    """
    if not len(a):
        return 1.0
    ends = [s[-1] for s in (a, b) if len(s) >= size]
    own = a[a <= min(ends)] if ends else a
    return len(np.intersect1d(own, b)) / len(own) if len(own) else 0.0


def distinct_shingles(a: np.ndarray, size: int = SIZE) -> float:
    return float(len(a)) if len(a) < size else (size - 1) / (float(a[size - 1]) / 2.0**63)


def sketches(column: pa.Array, size: int = SIZE, shingle: int = SHINGLE) -> list[np.ndarray]:
    return [hashes[:size].view(np.int64) for hashes in shingle_sets(column, shingle)]


def sketch_texts(parts: DataFrame, keys: list[str], text_col: str = "text", size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """The keys and `sketch`, an array of hashes, for each row; null and empty texts have none."""
    rows = parts.select(*keys, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(sketches(batch.column("__text"), size, shingle), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*keys, "sketch"])

    return rows.mapInArrow(run, schema)


def merge_sketches(parts: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    A key's hashes are cut to the smallest `size` in each of 64 salted groups and then once more,
    so that a key with most of the rows spreads. Keys without any hash get an empty sketch.
    """
    hashes = parts.select(*keys, F.explode_outer("sketch").alias("h")).distinct()
    salted = Window.partitionBy(*keys, F.pmod("h", F.lit(SALTS))).orderBy("h")
    few = hashes.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= size)
    last = few.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("h").asc_nulls_last())))
    return last.filter(F.col("n") <= size).groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """piece, doc_id, copy, text, dealt and sorted so that each document is followed by the next
    one in descending order of id; the first one follows the last.

    Ranges of ids are the pieces. The highest document of a range is the next one of the lowest
    document of the range above, so it goes there too, as a copy: one per range. Only ids are
    read to find these; texts are shuffled once. Null ids come last, ties are sorted by text.
    """
    n = shuffle_partitions(docs.sparkSession)
    borders = range_borders(docs, id_col, 4 * n)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(range_piece(borders, F.col("doc_id")).alias("piece"), "doc_id", "text")
    tops = {r.piece: r.top for r in rows.groupBy("piece").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(tops)
    above = {piece: used[(i + 1) % len(used)] for i, piece in enumerate(used)}

    def by_piece(values: dict[int, int]) -> Column:
        return F.lit([values.get(i) for i in range(len(borders) + 1)]).cast("array<bigint>")[F.col("piece")]

    own = F.struct(F.col("piece").cast("bigint").alias("piece"), F.lit(False).alias("copy"))
    copied = F.struct(by_piece(above).alias("piece"), F.lit(True).alias("copy"))
    is_top = F.col("doc_id").eqNullSafe(by_piece(tops))
    places = F.when(is_top, F.array(own, copied)).otherwise(F.array(own))
    return (
        rows.select("doc_id", "text", F.inline(places)).select("piece", "doc_id", "copy", "text")
        .repartition(n, "piece").sortWithinPartitions("piece", "copy", F.col("doc_id").desc_nulls_last(), "text")
    )


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(size: int, shingle: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    names = [c.split()[0] for c in PAIR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the last row: piece, doc_id, copy, text, sketch
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                own = sketches(part.column("text"), size, shingle)
                rows = held + list(zip(*(c.to_pylist() for c in part.columns), own))
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[2]]
                held = rows[-1:]
                if not pairs:
                    continue
                texts = [edited(a[3], b[3]) for a, b in pairs]
                changed = sketches(pa.array(texts, pa.large_string()), size, shingle)
                out = [
                    (a[1], len(a[3]), hashlib.sha256(t.encode()).hexdigest(), text_of(a[4]), text_of(c),
                     resemblance(a[4], c, size), resemblance(a[4], b[4], size),
                     distinct_shingles(a[4], size), containment(a[4], c, size))
                    for (a, b), t, c in zip(pairs, texts, changed)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles (estimate of distinct ones) and in_edited (containment). A null text is empty and
    has an empty fingerprint; repeated rows are documents of their own, in the order of their
    texts. An empty table gives no rows; other columns are not read.
    """
    return with_next(docs, id_col, text_col).mapInArrow(_pairs(size, shingle), PAIR)
