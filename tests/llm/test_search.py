"""Ranked lexical search, hard negatives and exact vector search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.hard_negatives import cover_tree, hard_negatives
from spanloom.llm.lexical import search
from spanloom.llm.vector_file import Bounds, marks_of, top_inner
from tests.llm.conftest import prose

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, first=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, counts in docs:
            m = 10 + (90 * sum(counts.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(terms(text)) if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:first])]
    return sorted(out, key=repr)


def test_search(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    extra = [(100 + i, prose(i % 7, 30) + " Ünïcödé rare" + str(i)) for i in range(40)] + [(99, "BIG " * 300_000), (98, None), (97, "...")]
    some = spark.createDataFrame(extra, "doc_id bigint, text string").selectExpr("doc_id", "text", "'b' as row", "'k' as kept", "1L as n_chars")
    items = [
        (1, prose(1, 30)), (1, prose(1, 30)), (2, prose(3, 40) + " RARE5 rare5"), (2, "Ünïcödé"), (3, None), (4, ""), (5, "nowhere-to-be-found"),
        (6, "big short TEXT"), (None, prose(7, 9)),
    ]
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit(1)).withColumn("score", F.lit("x"))
    got = search(docs.unionByName(some), asked, block_bytes=200)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows + extra, [i for i in items if i[1]])


def test_search_of_nothing(spark, docs, no_docs):
    asked = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert search(no_docs, asked).collect() == [] and search(docs, asked.limit(0)).collect() == []
    assert search(docs, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 4, [NAN, 0.0, 0.0, 0.0], [0.1, None, 0.2, 0.3], [INF, 0.0, 0.0, 0.0], [0.5], [0.5, 0.25]]


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, very many copies, odd vectors, null ids and labels, repeated rows and ids."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4))
    rows = [(i, (centres[i % 6] * (0.2 + i % 3) + 0.1 * rng.normal(size=4)).tolist(), int(i % 4)) for i in range(300)]
    rows += [(300 + i, centres[0].tolist(), int(i % 2)) for i in range(200)]  # copies
    rows += [(500 + i, v, 1) for i, v in enumerate(ODD)] + [(None, [1.0, 1.0, 1.0, 1.0], 1), (700, [1.0, 1.0, 1.0, 1.0], None)]
    rows += rows[:20] + [(40, [0.3, 0.1, -0.9, 0.2], 0), (100, [0.9, 0.1, 0.9, -0.2], 0)]
    schema = "vec_id bigint, embedding array<float>, label int"
    return spark.createDataFrame(rows, schema).withColumn("score", F.lit("x")).withColumn("part", F.lit("y")).repartition(5)


def usable(df, scale, labelled):
    out = set()
    for r in df.collect():
        v = r.embedding
        if r.vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (labelled and r.label is None):
            continue
        whole = [math.floor(scale * x) for x in v]
        out.add((r.vec_id, r.label if labelled else 0, tuple(whole + [0] * (4 - len(whole))), len(whole)))
    return sorted(out)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("part, block, k", [(4096, 1024, 20), (50, 7, 3), (64, 3, 400)])
def test_top_inner(vectors, part, block, k):
    rows, want = usable(vectors, 64, False), []
    for q in rows:
        if q[0] % 20 == 0:
            best = sorted((-dot(q[2], c[2]), c[0]) for c in rows if c != q)[:k]
            want += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = top_inner(vectors, F.col("vec_id") % 20 == 0, k, part=part, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_bounds_hold(spark, vectors):
    rows = usable(vectors, 64, False)
    classes = spark.createDataFrame([(i, list(r[2])) for i, r in enumerate(rows)], "c bigint, v array<bigint>")
    marks = marks_of(classes, 4)
    v = np.array([r[2] for r in rows])
    cell = np.stack([np.searchsorted(own, v[:, i], "right") - 1 for i, own in enumerate(marks)], axis=1)
    bounds = Bounds(marks)
    mid, half = (np.take_along_axis(x.T, cell, 0) for x in (bounds.mid, bounds.half))
    assert (np.abs(v - mid) <= half).all()


@pytest.mark.parametrize("part, block", [(2048, 512), (40, 2)])
def test_hard_negatives(vectors, part, block):
    rows, want = usable(vectors, 256, True), []
    for a in rows:
        if a[0] % 10:
            continue
        scored = sorted((-dot(a[2], c[2]), c[0], c[1], c) for c in rows if c != a)
        for ps, p, _, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:5]
            want += [(a[0], p, r + 1, x[1], -ps, -x[0]) for r, x in enumerate(fits)]
    got = hard_negatives(vectors, F.col("vec_id") % 10 == 0, F.col("label"), part=part, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_vectors(vectors):
    none = vectors.limit(0)
    assert top_inner(none, F.col("vec_id") % 20 == 0).collect() == []
    assert hard_negatives(none, F.col("vec_id") % 20 == 0, F.col("label")).collect() == []
    nobody = top_inner(vectors, F.col("vec_id") < 0)
    assert nobody.collect() == [] and nobody.columns == ["query_id", "rank", "vec_id", "score"]


def test_cover_tree_covers():
    """Each node's points lie within its radius, siblings' centres are apart, and each point has one leaf."""
    points = np.random.default_rng(1).normal(size=(400, 3))
    points[50:90] = points[50]
    nodes = list(cover_tree(points))
    parent = np.array([n[0] for n in nodes])
    leaf = np.bincount(parent[1:], minlength=len(nodes)) == 0
    assert sorted(nodes[i][3] for i in np.flatnonzero(leaf)) == list(range(400))
    for i in np.flatnonzero(leaf):
        up = parent[i]
        while up >= 0:
            assert np.linalg.norm(points[nodes[i][3]] - points[nodes[up][3]]) <= nodes[up][2] + 1e-9
            up = parent[up]
    for node in np.flatnonzero(~leaf):
        centres = [nodes[c][3] for c in np.flatnonzero(parent == node)]
        if not all(leaf[c] for c in np.flatnonzero(parent == node)):
            gaps = [np.linalg.norm(points[a] - points[b]) for i, a in enumerate(centres) for b in centres[:i]]
            assert min(gaps) > nodes[node][2] / 1.3 - 1e-9
