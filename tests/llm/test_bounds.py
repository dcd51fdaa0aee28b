"""Repeated ids, short benchmark items, long texts and the memory of workers."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, jaccard, suffixes, tokens, toxicity
from tests.llm.conftest import prose


def brute_kept(rows, threshold=0.8):
    """(id, text) that stay: the smallest (id, text hash) of each connected group, as texts per group."""
    shingles = {}
    for i, t in rows:
        words = t.split()
        shingles[i, t] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    nodes = sorted(shingles)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            both = shingles[a] & shingles[b]
            if a < b and len(both) >= threshold * len(shingles[a] | shingles[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return groups.values()


def test_repeated_ids_lose_no_text(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (2, a), (2, b), (5, b + " more words"), (5, b + " more words"), (7, c), (7, c), (7, prose(4, 60)), (8, a + " end"), (9, prose(5, 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit("x")).withColumn("first", F.lit(1))
    got = [(r.doc_id, r.text) for r in jaccard.drop_similar(df).collect()]
    assert jaccard.drop_similar(df).columns == df.columns
    groups = brute_kept(rows)
    assert len(got) == len(set(got)) == len(groups)
    for group in groups:  # one of each, with the smallest id
        kept = [x for x in got if x in group]
        assert len(kept) == 1 and kept[0][0] == min(i for i, _ in group)


def test_classes_of_repeated_ids(spark):
    """The text of a class is found by id and text, so a text that shares its id is not compared in its place."""
    base = prose(6, 100)
    rows = [(1, prose(7, 90)), (1, base), (2, base + " tail"), (3, prose(8, 50))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similarity_classes(df).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_items_of_few_words(spark):
    docs = spark.createDataFrame(
        [(1, "They asked: What is   SEVEN? Nobody knew"), (2, "the capital of France now is"), (3, "what seven is"), (4, "capital of Spain now, France"), (5, "yes!")],
        "doc_id bigint, text string",
    )
    items = spark.createDataFrame(
        [(1, "what is seven"), (2, "capital of France now"), (3, "Yes"), (4, "..."), (5, None), (6, "of France")], "item_id bigint, text string"
    )
    got = sorted((r.doc_id, r.item_id, r.n_equal) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(1, 1, 3), (2, 2, 4), (2, 6, 2), (5, 3, 1)]


def peak_mb(fn):
    tracemalloc.start()
    for _ in fn():
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def batch(texts, **columns):
    return pa.RecordBatch.from_arrays([pa.array(texts), *[pa.array(v) for v in columns.values()]], names=["text", *columns])


SHORT = [prose(i, 400) for i in range(1400)]  # about 4 MB
LONG = [" ".join(prose(i, 2000) for i in range(1200))]  # one text of about 20 MB


@pytest.mark.parametrize("texts, most", [(SHORT, 150), (LONG, 150)])
def test_memory_of_suffix_workers(texts, most):
    """The worst case, all windows probed; the text itself is not counted."""
    zeros = [0] * len(texts)
    rows = batch(texts, doc=list(range(len(texts))), tag=zeros)
    found = list(suffixes.entries_of(*tokens.buffer_of(rows.column("text"))))
    text, place, n, start = (np.concatenate([f[i] for f in found]) for i in (2, 3, 4, 0))
    probes = [[] for _ in texts]
    for t, p, k, s in zip(text.tolist(), place.tolist(), n.tolist(), start.tolist()):
        probes[t].append({"start": s, "place": p, "n": k})
    probed = batch(texts, doc=list(range(len(texts))), tag=zeros, fresh=[True] * len(texts), probes=probes)
    assert peak_mb(lambda: suffixes._sampled(iter([rows]))) < most
    assert peak_mb(lambda: suffixes._grams(iter([probed]))) < most
    assert len(tokens.powers(10)[0]) <= tokens.PIECE + 1024


def test_memory_of_words():
    data, offsets = tokens.buffer_of(pa.array(LONG))
    assert peak_mb(lambda: [tokens.word_hashes(data, offsets)]) < 150
    model = toxicity.Model(np.arange(1, 9, dtype=np.uint64), np.ones(8), np.array([0.0, 1.0]))
    assert peak_mb(lambda: [model.chances(pa.array(LONG))]) < 150


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_word_parts_change_no_word(most, monkeypatch):
    texts = ["", "One two", None, "..", "éa" * 30 + " x", "a b c d e f g h", " lead and trail ", "z" * 90]
    data, offsets = tokens.buffer_of(pa.array(texts))
    start, end, first = tokens.word_spans(data, offsets)
    want = tokens.Spans(data, tokens.FOLDED).hash(start, end)
    monkeypatch.setattr(tokens, "PIECE", max(1, most // 2))
    hashes, begins = tokens.word_hashes(data, offsets)
    assert (hashes == want).all() and (begins == first).all()
    assert tokens.word_hashes(*tokens.buffer_of(pa.array([], pa.string())))[1].tolist() == [0]
