"""Severity of toxic text: cumulative-link ordinal regression on sparse word features.

Features are words and the first 3 to 6 bytes of words, so that inflected and compounded forms
count too. The model has one weight per feature of a small vocabulary and ordered thresholds t1 < t2; the chance
that the grade reaches k is sigmoid(weights . features - tk). Expected severity is the sum of these
chances. Grades: 0 clean, 1 toxic, 2 toxic with more of the telling words than half of the toxic
training documents have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import Steps
from spanloom.llm.tokens import FOLDED, STEP, Spans, buffer_of, pieces, shingle_hashes, word_parts, word_spans

SAMPLE_ROWS = 16_000  # most labelled documents that the model is fitted on, half of them toxic
VOCABULARY = 4096  # most words
LEAST_Z = 5.0  # how sure a feature's use must differ between toxic and clean documents
LEAST_SHARE = 0.01  # of the toxic documents that must have a feature, 3 at least
LEAST_LIFT = 10.0  # times as often in toxic as in clean documents, so that plain words stay out
PREFIXES = (3, 4, 5, 6)
GRADES = 3


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each feature, one by one; and the words' hashes with their first ones."""
    start, end, first = word_spans(data, offsets)
    spans, text = Spans(data, FOLDED), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = spans.hash(start, end)
    hashes, texts = [words], [text]
    for size in PREFIXES:
        long = np.flatnonzero(end - start > size)
        hashes.append(spans.hash(start[long], start[long] + size) ^ STEP[size])
        texts.append(text[long])
    return np.concatenate(hashes), np.concatenate(texts), words, first


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and value of each feature that is not 0."""
        known, found = np.zeros(1 << 16, bool), []
        known[(self.words & np.uint64(0xFFFF)).astype(int)] = True
        for low, part, inner in word_parts(data, offsets):
            hashes, text, _, _ = features_of(part, inner)
            at = np.flatnonzero(known[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.searchsorted(self.words, hashes[at])
            hit = self.words[np.minimum(place, len(self.words) - 1)] == hashes[at]
            found.append((low + text[at[hit]]) * len(self.words) + place[hit])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        return keys // len(self.words), keys % len(self.words), np.log2(1.0 + counts)

    def chances(self, column: pa.Array) -> np.ndarray:
        """For each text, the chances that its grade reaches 1, 2 and so on."""
        data, offsets = buffer_of(column)
        score = np.zeros(len(offsets) - 1)
        if len(self.words):
            for low, high in pieces(offsets):
                text, word, value = self.features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                score[low:high] = np.bincount(text, self.weights[word] * value, high - low)
        return sigmoid(score[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, words: np.ndarray, values: np.ndarray, grades: np.ndarray, n_words: int,
    steps: int = 600, rate: float = 0.1, decay: float = 1e-4, mass: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds with the least penalised negative log likelihood, by Adam.

    `mass` says how many documents each stands for, on a scale with mean 1; without it, one each.
    """
    n, k = len(grades), GRADES - 1
    mass = np.ones(n) if mass is None else mass
    share = np.array([np.average(grades >= g, weights=mass) for g in range(1, GRADES)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-2 * np.arange(k))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(n_words), start[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        weights, thresholds = x[:n_words], np.cumsum(np.concatenate([x[n_words : n_words + 1], np.exp(x[n_words + 1 :])]))
        score = np.bincount(rows, weights[words] * values, n)
        reach = np.hstack([np.ones((n, 1)), sigmoid(score[:, None] - thresholds), np.zeros((n, 1))])
        slope = reach * (1 - reach)
        upper, lower = reach[np.arange(n), grades], reach[np.arange(n), grades + 1]
        chance = np.maximum(upper - lower, 1e-9) / mass
        by_score = -(slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / chance
        by_threshold = np.array([
            np.sum(np.where(grades == g, slope[:, g] / chance, 0) - np.where(grades == g - 1, slope[:, g] / chance, 0))
            for g in range(1, GRADES)
        ])
        by_weight = np.bincount(words, by_score[rows] * values, n_words) + decay * n * weights
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([by_weight, tail[:1], tail[1:] * np.exp(x[n_words + 1 :])]) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_words], np.cumsum(np.concatenate([x[n_words : n_words + 1], np.exp(x[n_words + 1 :])]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with counts, and two min-hashes of three-word shingles, for each text."""
    lists, longs = pa.list_(pa.int64()), pa.int64()
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        found, counts, ones, twos = [], [], [], []
        for low, high in pieces(offsets):
            hashes, text, words, first = features_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            order = np.argsort(text, kind="stable")
            hashes, begin = hashes[order], np.searchsorted(text[order], np.arange(high - low + 1))
            shingles, start = shingle_hashes(words, first, 3)
            for i in range(high - low):
                one, count = np.unique(hashes[begin[i] : begin[i + 1]], return_counts=True)
                found.append(one.view(np.int64))
                counts.append(count)
                own = shingles[start[i] : start[i + 1]]
                ones.append(int(own.min() >> np.uint64(1)) if len(own) else None)
                twos.append(int((own * STEP[0]).min() >> np.uint64(1)) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(found, lists), pa.array(counts, lists),
             pa.array(ones, longs), pa.array(twos, longs)],
            names=["doc_id", "toxic", "words", "counts", "one", "two"],
        )


COUNTED = "doc_id bigint, toxic int, words array<bigint>, counts array<bigint>, one bigint, two bigint"


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most `sample_rows` labelled documents, those with the smallest hashes of their id
    in each class; of near copies within a class one is used. Each class counts with the number of
    all its labels, however many of them are sampled, so that the thresholds fit the real shares at
    every size. Null ids and labels are left out. Without both classes, all is clean.

    The ids of the sample are bounded, so they are broadcast and the texts stay where they are.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic in (0, 1)"
    ).distinct()
    classes = [
        known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
        for toxic in (0, 1)
    ]
    steps = Steps(spark)
    sample = steps.write(classes[0].unionByName(classes[1]), "toxic-sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    counted = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "text").mapInArrow(_counted, COUNTED)
    for key in ("one", "two"):  # near copies say nothing new; the first of them stays
        place = F.row_number().over(Window.partitionBy("toxic", key).orderBy("doc_id"))
        counted = counted.withColumn("place", place).filter("place = 1").drop("place")
    counted = steps.write(counted.withColumn("row", F.monotonically_increasing_id()), "toxic-words")
    n = {r.toxic: r["count"] for r in counted.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    nothing = Model(np.empty(0, np.uint64), np.empty(0), np.array([40.0, 41.0]))
    if not clean or not toxic:
        return nothing
    all_labels = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    used = counted.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    pooled = (F.col("a") + F.col("b")) / (clean + toxic)
    z = (F.col("a") / toxic - F.col("b") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean))
    told = (
        used.filter((F.col("a") >= max(3, LEAST_SHARE * toxic)) & (F.col("a") / toxic >= LEAST_LIFT * F.col("b") / clean))
        .select("word", z.alias("z")).filter(F.col("z") >= LEAST_Z)
        .orderBy(F.col("z").desc(), "word").limit(VOCABULARY).collect()
    )
    if not told:
        return nothing
    vocabulary = np.array(sorted(r.word & (1 << 64) - 1 for r in told), np.uint64)
    chosen = spark.createDataFrame([(r.word,) for r in told], "word bigint")
    entries = (
        counted.select("toxic", "row", F.explode(F.arrays_zip("words", "counts")).alias("e"))
        .select("toxic", "row", F.col("e.words").alias("word"), F.col("e.counts").alias("count"))
        .join(F.broadcast(chosen), "word").select("toxic", "row", "word", "count").toPandas()
    )
    return _fitted(entries, vocabulary, clean, toxic, all_labels[0], all_labels[1])


def _fitted(entries, vocabulary: np.ndarray, clean: int, toxic: int, all_clean: int, all_toxic: int) -> Model:
    """The model, from the known words of each sampled document; those without any count too.

    The sampled documents of a class stand for all labels of the class.
    """
    ids, rows = np.unique(entries["row"].to_numpy(), return_inverse=True)
    label = np.zeros(len(ids), int)
    label[rows] = entries["toxic"].to_numpy()
    missing = [max(0, clean - int((label == 0).sum())), max(0, toxic - int(label.sum()))]
    label = np.concatenate([label, np.zeros(missing[0], int), np.ones(missing[1], int)])
    words = np.searchsorted(vocabulary, entries["word"].to_numpy().view(np.uint64))
    order = np.lexsort((words, rows))
    rows, words = rows[order], words[order]
    counts = entries["count"].to_numpy()[order]
    telling = np.bincount(rows, counts, len(label))
    usual = np.median(telling[label == 1])
    grades = np.where(label == 0, 0, np.where(telling > usual, 2, 1))
    mass = np.where(label == 0, all_clean / clean, all_toxic / toxic)
    weights, thresholds = fit_ordinal(rows, words, np.log2(1.0 + counts), grades, len(vocabulary), mass=mass / mass.mean())
    return Model(vocabulary, weights, thresholds)


def _scored(model: Model, field: T.StructField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = model.chances(batch.column("text"))
            reach = np.hstack([np.ones((len(chances), 1)), chances, np.zeros((len(chances), 1))])
            grade = np.argmax(reach[:, :-1] - reach[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(chances.sum(axis=1)), pa.array(chances[:, 0]),
                 pa.array(grade.astype(np.int64)), pa.array(chances[:, 0] >= 0.5)],
                names=["kept", "severity", "p_toxic", "grade", "toxic"],
            )

    return run


def score(docs: DataFrame, model: Model, keep, text_col: str = "text") -> DataFrame:
    """kept, severity, p_toxic, grade, toxic per row, where `keep` is the column to carry along.

    severity runs from 0 to 2; a document is toxic where grade 1 or more is likelier than not. A
    null or empty text has no features. Repeated rows are scored each on their own.
    """
    rows = docs.select(keep.alias("kept"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["kept"], T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()),
        T.StructField("grade", T.LongType()), T.StructField("toxic", T.BooleanType()),
    ])
    return rows.mapInArrow(_scored(model, rows.schema["kept"]), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity, p_toxic, grade, toxic: one row per document."""
    scored = score(docs, fit(docs, labels, id_col, text_col), F.col(id_col), text_col)
    return scored.withColumnRenamed("kept", "doc_id")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    kept = score(docs, fit(docs, labels), F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.filter(~F.col("toxic")).select("kept.*")
