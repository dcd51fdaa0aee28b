"""Similarity join of documents on word shingles: MinHash bands, then exact verification.

Texts with equal shingle sets are one class. Classes that agree on a band meet in a bucket. In
each bucket the document with the smallest id is the pivot, and all others are compared with it on
full shingle sets, so a bucket of m classes costs m comparisons and each gives the difference of a
set to its pivot's. Classes within half of the same pivot are a family: the size of the
intersection of any two follows exactly from their differences, so links inside a family need no
texts. Pairs of a bucket in different families are compared on full sets too, unless their
similarities to the pivot rule a link out (Jaccard distance is a metric).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Steps, few_tasks, shuffle_partitions
from spanloom.llm.components import components
from spanloom.llm.tokens import STEP, mix, numbers, shingle_sets

SHINGLE = 5  # words
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs at the threshold
MOST_HASHES = 288
FAMILY = 0.5  # similarity to a pivot that makes a member
BLOCK = 1024  # members that are compared with as many others at a time
FEW = 50_000  # document ids that are broadcast, instead of a join of all texts
ROWS = 65_536  # slim rows of a task
LISTS = 4096  # rows with a list of hashes
TEXTS = 1024  # rows with a text

SIGNED = "doc_id bigint, h bigint, key bigint, n bigint, bands array<bigint>"
COMPARED = "key bigint, pivot bigint, n bigint, n_pivot bigint, shared bigint, difference array<bigint>"
LINKED = "key bigint, links bigint, root bigint"


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which so many hashes give pairs at the threshold the recall."""
    for rows in range(most, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no number of bands gives this recall")


def _signed(bands: int, rows: int, shingle: int):
    factors, seeds = numbers(bands * rows, 3), numbers(bands, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sets = list(shingle_sets(part.column("text"), shingle))
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                keys = [None] * len(sets)
                signed = [[]] * len(sets)
                if len(some):
                    hashes = mix(np.concatenate([sets[i] for i in some]))
                    begin = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    least = np.stack([np.minimum.reduceat(hashes * f, begin) for f in factors], axis=1)
                    key = mix(np.add.reduceat(mix(hashes + STEP[0]), begin) + sizes[some].astype(np.uint64)).view(np.int64)
                    bound = least.reshape(len(some), bands, rows)
                    code = mix((bound * STEP[:rows]).sum(axis=2, dtype=np.uint64) + seeds).view(np.int64)
                    for place, i in enumerate(some):
                        keys[i], signed[i] = int(key[place]), code[place]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "key", "n", "bands"],
                )

    return run


def sign(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, hash of the text, key of the shingle set (null: no shingles), its size, and a hash for each band."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return docs.mapInArrow(_signed(*choose_bands(threshold, recall), shingle), SIGNED)


def _compared(shingle: int):
    """Rows come grouped by pivot, its own text first; sets are compared one by one."""
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int64())]
    names = [c.split()[0] for c in COMPARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("pivot", "salt", "key")]
            for pivot, salt, key, found in zip(*columns, shingle_sets(batch.column("text"), shingle)):
                if key == pivot:
                    group, own = (pivot, salt), found
                    continue
                if group != (pivot, salt):
                    raise ValueError("a pivot's text is missing")
                place = np.minimum(np.searchsorted(own, found), len(own) - 1)
                both = own[place] == found
                shared = int(both.sum())
                difference = None
                if shared >= FAMILY * (len(own) + len(found) - shared):
                    gone = np.ones(len(own), bool)
                    gone[place[both]] = False
                    difference = np.concatenate([found[~both], own[gone]]).view(np.int64)
                out.append((key, pivot, len(found), len(own), shared, difference))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def compare(docs: DataFrame, pairs: DataFrame, classes: DataFrame, steps: Steps, shingle: int, name: str) -> DataFrame:
    """Exact comparison of `pairs` (key, pivot) on the full sets of their documents.

    A document is told by its id and the hash of its text, as an id may come with several texts.
    The rows of a pivot are dealt to salted groups of about BLOCK, each with the pivot's text; so
    no task depends on how many share a pivot. Texts are read with a join on ids, after a filter
    on broadcast ids if these are few.
    """
    docs = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), "text")
    ids = classes.select("key", "doc", "h")
    pairs = steps.write(pairs, f"{name}-pairs")
    most = 2 * pairs.count()  # a member each, and no more pivots
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    members = pairs.join(salts, "pivot").select("key", "pivot", F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt"))
    pivots = salts.select(F.col("pivot").alias("key"), "pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    wanted = steps.write(few_tasks(members.unionByName(pivots).join(ids, "key"), most, ROWS), f"{name}-wanted")
    few = wanted.select("doc").distinct()
    if few.limit(FEW + 1).count() <= FEW:
        docs = docs.join(F.broadcast(few), "doc", "left_semi")
        rows = docs.join(wanted, ["doc", "h"])
    else:
        rows = docs.join(wanted.hint("merge"), ["doc", "h"])
    n = shuffle_partitions(docs.sparkSession)
    dealt = few_tasks(rows.repartition(n, "pivot", "salt"), most, TEXTS).sortWithinPartitions("pivot", "salt", F.col("key") != F.col("pivot"), "key")
    return steps.write(dealt.select("pivot", "salt", "key", "text").mapInArrow(_compared(shingle), COMPARED), name)


def enough(shared, n, m, threshold: float):
    """Whether the Jaccard similarity reaches the threshold; for columns and arrays alike."""
    return shared >= threshold * (n + m - shared) - 1e-9


def _linked(threshold: float):
    """Rows come grouped by family and pair of blocks: a block is compared with itself or another."""
    kinds = [pa.int64()] * 3
    names = ["key", "links", "root"]

    def block(rows: list[tuple]) -> pa.RecordBatch | None:
        _, a, b, side, key, copies, n, n_pivot, difference = zip(*rows)
        side, key, copies, n = np.array(side), np.array(key), np.array(copies), np.array(n)
        sizes = np.array([len(d) for d in difference])
        row = np.repeat(np.arange(len(rows)), sizes)
        elements, place, count = np.unique(
            np.concatenate([np.asarray(d, np.int64) for d in difference]), return_inverse=True, return_counts=True
        )
        mine, theirs = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if a[0] != b[0] else [np.arange(len(rows))] * 2
        shared = np.zeros((len(mine), len(theirs)), np.float32)
        often = np.flatnonzero(count > 1)
        column = np.full(len(elements), -1)
        column[often] = np.arange(len(often))
        for low in range(0, len(often), BLOCK):
            used = (column[place] >= low) & (column[place] < low + BLOCK)
            grid = np.zeros((len(rows), min(BLOCK, len(often) - low)), np.float32)
            grid[row[used], column[place[used]] - low] = 1
            shared += grid[mine] @ grid[theirs].T
        # Of the pivot's shingles some are gone from a set. What both lack is counted twice, what both
        # have beyond the pivot not at all: `shared` counts these two.
        gone = (sizes + np.array(n_pivot) - n) // 2  # of the pivot's shingles
        common = np.array(n_pivot)[mine][:, None] - gone[mine][:, None] - gone[theirs][None, :] + shared
        link = enough(common, n[mine][:, None], n[theirs][None, :], threshold)
        link &= key[mine][:, None] != key[theirs][None, :]
        if not link.any():
            return None
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        links[mine] += link @ copies[theirs]
        if a[0] != b[0]:
            links[theirs] += copies[mine] @ link
        while True:  # the smallest row number spreads along links
            before = root.copy()
            root[mine] = np.minimum(root[mine], np.where(link, root[theirs][None, :], len(rows)).min(axis=1))
            root[theirs] = np.minimum(root[theirs], np.where(link, root[mine][:, None], len(rows)).min(axis=0))
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(links[some]), pa.array(key[root[some]])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    found = block(held)
                    held = []
                    if found is not None:
                        yield found
                held.append(row)
        if held and (found := block(held)) is not None:
            yield found

    return run


def family_links(members: DataFrame, threshold: float) -> DataFrame:
    """key, links, root: linked documents within families, and a key each is connected to.

    Takes family, key, copies, n, n_pivot, difference. A family is dealt to blocks of about BLOCK
    members; each pair of blocks is one group, so its rows are sent once per block, and no task
    holds more than two blocks.
    """
    n = shuffle_partitions(members.sparkSession)
    size = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("size"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    placed = members.join(size.filter("size > 1"), "family").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    )
    grouped = placed.select(
        "family", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "copies", "n", "n_pivot", "difference",
    )
    return (
        grouped.repartition(n, "family", "a", "b").sortWithinPartitions("family", "a", "b", "side", "key")
        .mapInArrow(_linked(threshold), LINKED)
    )


def cross_pairs(stars: DataFrame, buckets: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """key and pivot of pairs that share a bucket but no family, as far as a link is possible.

    Only buckets whose members are in different families take part. By the triangle inequality two
    members link only if their similarities to the bucket's pivot differ by 1 - threshold at most,
    and the smaller set has at least the threshold's share of the larger one's size.
    """
    near = stars.select("key", "pivot", "n", (F.col("shared") / (F.col("n") + F.col("n_pivot") - F.col("shared"))).alias("near"))
    placed = buckets.join(families.select("key", "family"), "key")
    mixed = placed.groupBy("band").agg(F.min("family").alias("low"), F.max("family").alias("high")).filter("low <> high").select("band")
    rows = placed.join(mixed, "band").join(near, ["key", "pivot"])
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.abs(F.col("a.near") - F.col("b.near")) > 1 - threshold + 1e-9
    uneven = F.least("a.n", "b.n") < threshold * F.greatest("a.n", "b.n") - 1e-9
    may = (F.col("a.key") < F.col("b.key")) & (F.col("a.family") != F.col("b.family")) & ~apart & ~uneven
    return a.join(b, (F.col("a.band") == F.col("b.band")) & may).select(
        F.col("a.key").alias("key"), F.col("b.key").alias("pivot")
    ).distinct()


def classified(rows: DataFrame, threshold: float, recall: float, shingle: int) -> DataFrame:
    """doc_id, h, first, n_links, n for each row of doc_id and text, h being the hash of the text.

    `first` has the smallest doc and h of the row's class; it is null for rows without shingles or id.
    """
    steps = Steps(rows.sparkSession)
    signed = steps.write(sign(rows, threshold, recall, shingle), "signed")
    known = signed.filter("key is not null and doc_id is not null")
    n = signed.count()
    classes = steps.write(
        few_tasks(known.groupBy("key").agg(
            F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ).select("key", F.col("first.doc_id").alias("doc"), "first.h", "copies", "n", "bands"), n, LISTS), "classes",
    )
    banded = classes.select("key", "doc", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("doc", "key")).alias("p"), F.count("*").alias("size"))
    shared = shared.filter("size > 1").select("band", F.col("p.key").alias("pivot"))
    bands = choose_bands(threshold, recall)[0]
    buckets = steps.write(few_tasks(banded.select("key", "band").join(shared, "band"), bands * n, ROWS), "buckets")
    in_buckets = buckets.filter("key <> pivot").select("key", "pivot").distinct()
    stars = compare(rows, few_tasks(in_buckets, buckets.count(), ROWS), classes, steps, shingle, "stars")

    near = stars.filter("difference is not null").join(classes.select(F.col("key").alias("pivot"), F.col("doc").alias("p_doc")), "pivot")
    first = near.groupBy("key").agg(F.min_by(F.struct("pivot", "n", "n_pivot", "difference"), F.struct("p_doc", "pivot")).alias("s"))
    members = first.select("key", F.col("s.pivot").alias("family"), "s.n", "s.n_pivot", "s.difference")
    heads = members.select(F.col("family").alias("key"), "n_pivot").distinct().join(members.select("key"), "key", "left_anti").select(
        "key", F.col("key").alias("family"), F.col("n_pivot").alias("n"), "n_pivot", F.array().cast("array<bigint>").alias("difference")
    )
    families = steps.write(
        few_tasks(members.unionByName(heads).join(classes.select("key", "copies"), "key"), n, LISTS), "families"
    )
    inside = steps.write(family_links(families, threshold), "family-links")

    alone = buckets.select("key").distinct().join(families.select("key"), "key", "left_anti").select("key", F.col("key").alias("family"))
    homes = steps.write(few_tasks(families.select("key", "family").unionByName(alone), n, ROWS), "homes")
    crossing = compare(rows, cross_pairs(stars, buckets, homes, threshold), classes, steps, shingle, "crossing")
    home_of = lambda name: homes.select(F.col("key").alias(name), F.col("family").alias(f"{name}_home"))
    over = (
        stars.drop("difference").unionByName(crossing.drop("difference"))
        .filter(enough(F.col("shared"), F.col("n"), F.col("n_pivot"), threshold))
        .join(home_of("key"), "key").join(home_of("pivot"), "pivot").filter("key_home <> pivot_home")
        .select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    )
    over = steps.write(over, "links-between")
    copies = lambda name: classes.select(F.col("key").alias(name), F.col("copies").alias("links"))
    counts = (
        inside.select("key", "links")
        .unionByName(over.join(copies("b"), "b").select(F.col("a").alias("key"), "links"))
        .unionByName(over.join(copies("a"), "a").select(F.col("b").alias("key"), "links"))
        .groupBy("key").agg(F.sum("links").alias("links"))
    )
    roots = components(inside.select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(over), steps)
    own = F.struct("doc", "h")
    named = roots.join(classes.select(F.col("key").alias("node"), own.alias("own")), "node")
    smallest = named.groupBy("root").agg(F.min("own").alias("first"))
    answer = (
        classes.select("key", own.alias("own"), "copies").join(counts, "key", "left")
        .join(named.join(smallest, "root").select(F.col("node").alias("key"), "first"), "key", "left")
        .select("key", F.coalesce("first", "own").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return signed.join(answer, "key", "left").select(
        "doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"), "n_links", "n"
    )


def similarity_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    recall: float = RECALL, shingle: int = SHINGLE,
) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles: one row per document.

    `n_links` counts the other documents whose shingle sets have a Jaccard similarity of at least
    `threshold`, equal ones included; `class_id` is the smallest doc_id that links lead to. Nothing
    is capped. Null and empty texts have no shingles and link to nothing; a text without words
    equals only the same text; one of fewer words than a shingle has one shingle. A null doc_id
    stands alone with a null class. Rows that repeat an id count as documents. An empty table gives
    no rows; other columns are not read. Equal sets are told by 64-bit hashes of whole sets.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = F.col("doc_id").isNotNull()
    return classified(rows, threshold, recall, shingle).select(
        "doc_id", F.when(known, F.coalesce("first.doc", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), F.col("n").alias("n_shingles"),
    )


def drop_similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class, with all columns: that with the smallest doc_id, then hash of the text.

    Rows with a null doc_id stay, and so do rows without shingles, but of rows that repeat both id and
    text one stays. An id may come with several texts: each is judged by itself.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = classified(rows, threshold, recall, shingle).filter("doc_id is not null")
    counted = found.groupBy("doc_id", "h").agg(F.max("first").alias("first"), F.count("*").alias("rows"))
    stays = F.col("first").isNull() | (F.col("first") == F.struct(F.col("doc_id").alias("doc"), "h"))
    told = Steps(docs.sparkSession).write(counted.select("doc_id", "h", "rows", stays.alias("stays")).filter("rows > 1 or not stays"), "told")
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    all_rows = docs.select(kept, F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    once = all_rows.join(told.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select("kept")
    if told.filter("stays").isEmpty():
        return once.select("kept.*")
    repeated = all_rows.join(told.filter("stays").select("doc_id", "h"), ["doc_id", "h"], "left_semi")
    repeated = repeated.groupBy("doc_id", "h").agg(F.first("kept").alias("kept")).select("kept")
    return once.unionByName(repeated).select("kept.*")
