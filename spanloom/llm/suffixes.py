"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

A match is a string of 100 bytes. Of each such window only one suffix is indexed: that at the
window's smallest hash of 32 bytes. Equal windows choose the same place, so sampled suffixes with
different first 32 bytes share no window, and a suffix array needs about one entry in 35 bytes.
Its entries are sorted by a 64-bit hash of those first bytes, then by a hash of the whole run of
windows that chose the place; only first occurrences of a run are kept.

Documents come in batches, in ascending order of id. The suffix array of a batch is merge-scanned
with the levels before it: runs that occur earlier are repeats as a whole, and where runs differ
behind equal first bytes their windows are compared one by one, for several batches together. The array
becomes a level, and levels of equal size merge, so there are at most log2(batches) + 1 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import Steps, range_borders, shuffle_partitions
from spanloom.llm.tokens import PIECE, RAW, Spans, buffer_of, pieces

WINDOW = 100  # bytes of a match
SEED = 32  # bytes that sort a suffix
BATCHES = 4
HELD = 100_000  # entries of one suffix start that a scan looks at together

NONE = -(1 << 63)  # stands for a null id: before all others
TAG = 40  # a place is a hash of the document's text, shifted by so many bits, plus the byte position
TAGS = 1 << 22

# kind 0: a repeat, of n windows from place on. 1: an entry. 2: an entry of an older level. 3: a probe.
ENTRY = "kind int, start bigint, run bigint, doc bigint, place bigint, n bigint"
GRAM = "kind int, start bigint, gram bigint, fresh boolean, doc bigint, place bigint, n bigint"
REPEAT = "doc bigint, place bigint, n bigint"


def entries_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Start hash, run hash, text, byte position and windows of each entry of some texts."""
    for low, high in pieces(offsets):
        size = int(offsets[high] - offsets[low])
        # A long text is looked at in parts; windows begin in one part and may end in the next.
        for skip in range(0, max(1, size - WINDOW + 1), PIECE):
            begin = int(offsets[low]) + skip
            end = min(begin + PIECE + WINDOW - 1, int(offsets[high])) if size > PIECE else int(offsets[high])
            part = data[begin:end]
            if len(part) < WINDOW:
                continue
            ends = np.clip(offsets[low + 1 : high + 1] - begin, 0, len(part))
            starts = np.clip(offsets[low:high] - begin, 0, len(part))
            spans = Spans(part, RAW)
            at = np.arange(len(part) - SEED + 1)
            seeds = spans.hash(at, at + SEED)
            mask = np.uint64((1 << 21) - 1)
            least = (seeds & ~mask) | at.astype(np.uint64)
            width, target = 1, WINDOW - SEED + 1
            while width * 2 <= target:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < target:
                least = np.minimum(least[: -(target - width)], least[target - width :])
            chosen = (least & mask).astype(np.int64)
            for text_end, text_start in zip(ends, starts):  # no window crosses a border
                chosen[max(text_start, text_end - WINDOW + 1) : text_end] = -1
            change = chosen[1:] != chosen[:-1]
            first = np.flatnonzero(np.concatenate([[True], change]) & (chosen >= 0))
            last = np.flatnonzero(np.concatenate([change, [True]]) & (chosen >= 0))
            text = np.searchsorted(offsets, first + begin, "right") - 1
            yield (
                seeds[chosen[first]].view(np.int64), spans.hash(first, last + WINDOW).view(np.int64),
                text, first + begin - offsets[text], last - first + 1,
            )


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def joined(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same windows with neighbouring and overlapping stretches of a document as one."""
    order = np.lexsort((place, doc))
    doc, place, n = doc[order], place[order], n[order]
    if not len(doc):
        return doc, place, n
    position = place & ((1 << TAG) - 1)
    group = np.cumsum(_changes(doc, place >> TAG)) - 1
    shift = group * (int((position + n).max()) + 2)
    reach = np.maximum.accumulate(position + n + shift)
    new = np.ones(len(doc), bool)
    new[1:] = position[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    until = np.append(first[1:], len(doc)) - 1
    return doc[first], place[first], reach[until] - shift[first] - position[first]


def _first_entries(found: list[tuple[np.ndarray, ...]], ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    """Entries, less those that a smaller one among them makes a repeat."""
    start, run, text, position, n = (np.concatenate(c) for c in zip(*found))
    doc, place = ids[text], (tags[text] << TAG) + position
    order = np.lexsort((place, doc, run, start))
    start, run, doc, place, n = (c[order] for c in (start, run, doc, place, n))
    new = _changes(start, run)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = ~new & ((doc != doc[first]) | (place != place[first]))
    r_doc, r_place, r_n = joined(doc[again], place[again], n[again])
    zero = np.zeros(len(r_doc), np.int64)
    kind = np.concatenate([np.zeros(len(r_doc), np.int32), np.ones(new.sum(), np.int32)])
    return _batch([
        kind, np.concatenate([r_doc * 31 + r_place, start[new]]), np.concatenate([zero, run[new]]),
        np.concatenate([r_doc, doc[new]]), np.concatenate([r_place, place[new]]), np.concatenate([r_n, n[new]]),
    ], [c.split()[0] for c in ENTRY.split(", ")])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of texts; of equal ones among up to about HELD the first."""
    for batch in batches:
        ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
        found, size = [], 0
        for part in entries_of(*buffer_of(batch.column("text"))):
            found.append(part)
            size += len(part[0])
            if size > HELD:
                yield _first_entries(found, ids, tags)
                found, size = [], 0
        if found:
            yield _first_entries(found, ids, tags)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge scan of sorted entries, old before new: repeats, new first entries, and probes.

    Probes are the entries whose start has several runs, one of them new. Starts are looked at as a
    whole, up to HELD entries; what comes beyond that are probes all.
    """
    names = [c.split()[0] for c in ENTRY.split(", ")]
    before = None  # start, run, doc, place of the first entry of the last run that was given out
    forced = None  # a start of which a part was given out

    def part(rows: list[np.ndarray], whole: bool) -> pa.RecordBatch | None:
        nonlocal before, forced
        kind, start, run, doc, place, n = rows
        if not len(kind):
            return None
        new = _changes(start, run)
        if before is not None and (start[0], run[0]) == before[:2]:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first_doc = np.where(at >= 0, doc[at], before[2] if before is not None else 0)
        first_place = np.where(at >= 0, place[at], before[3] if before is not None else 0)
        again = ~new & (kind == 1) & ((doc != first_doc) | (place != first_place))
        group = np.cumsum(_changes(start)) - 1
        runs = np.bincount(group, new)
        some_new = np.bincount(group, new & (kind == 1))
        probe = new & ((runs > 1) & (some_new > 0))[group]
        if forced is not None:
            probe |= new & (start == forced)
        if not whole:
            probe |= new & (start == start[-1])
            forced = start[-1]
        before = (start[-1], run[-1], first_doc[-1], first_place[-1])
        r_doc, r_place, r_n = joined(doc[again], place[again], n[again])
        fresh, zero = new & (kind == 1), np.zeros(len(r_doc), np.int64)
        probe_kind = np.where(kind[probe] == 1, 3, 4)
        return _batch([
            np.concatenate([zero, kind[fresh], probe_kind]).astype(np.int32),
            np.concatenate([zero, start[fresh], start[probe]]), np.concatenate([zero, run[fresh], run[probe]]),
            np.concatenate([r_doc, doc[fresh], doc[probe]]), np.concatenate([r_place, place[fresh], place[probe]]),
            np.concatenate([r_n, n[fresh], n[probe]]),
        ], names)

    held = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        repeats = rows[0] == 0
        if repeats.any():
            yield _batch([c[repeats] for c in rows], names)
            rows = [c[~repeats] for c in rows]
        rows = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[1], rows[1][-1], "left"))  # where the last start begins
        if len(rows[0]) - cut > HELD:
            cut, whole = len(rows[0]), False
        else:
            whole = True
        found = part([c[:cut] for c in rows], whole)
        held = [c[cut:] for c in rows]
        if found is not None:
            yield found
    if held is not None and (found := part(held, True)) is not None:
        yield found


def _probed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """start, gram, fresh, doc, place of the windows of probes, a bounded part of the texts at a time."""
    data, offsets = buffer_of(batch.column("text"))
    docs, tags, news = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag", "fresh"))
    probes = batch.column("probes")
    rows = probes.flatten()
    starts, places, ns = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("start", "place", "n"))
    text = np.repeat(np.arange(len(probes)), np.diff(probes.offsets.to_numpy()))
    at = offsets[text] + places - (tags[text] << TAG)  # in the data
    order = np.argsort(at, kind="stable")
    for begin in range(0, len(data), PIECE):
        low, high = np.searchsorted(at[order], [begin, begin + PIECE])
        own = order[low:high]
        if not len(own):
            continue
        n = ns[own]
        end = int((at[own] + n).max()) + WINDOW - 1
        spans = Spans(data[begin:end], RAW)
        which = own[np.repeat(np.arange(len(own)), n)]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        position = at[which] + step - begin
        gram = spans.hash(position, position + WINDOW).view(np.int64)
        yield starts[which], gram, news[text[which]], docs[text[which]], places[which] + step


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each window of the probes of some documents; of equal ones in a part the first."""
    names = [c.split()[0] for c in GRAM.split(", ")]
    for batch in batches:
        for start, gram, fresh, doc, place in _probed(batch):
            order = np.lexsort((place, doc, fresh, gram, start))
            start, gram, fresh, doc, place = (c[order] for c in (start, gram, fresh, doc, place))
            new = _changes(start, gram)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & fresh & ((doc != doc[first]) | (place != place[first]))
            r_doc, r_place, r_n = joined(doc[again], place[again], np.ones(again.sum(), np.int64))
            zero = np.zeros(len(r_doc), np.int64)
            yield _batch([
                np.concatenate([np.zeros(len(r_doc), np.int32), np.ones(new.sum(), np.int32)]),
                np.concatenate([r_doc * 31 + r_place, start[new]]), np.concatenate([zero, gram[new]]),
                np.concatenate([np.ones(len(r_doc), bool), fresh[new]]), np.concatenate([r_doc, doc[new]]),
                np.concatenate([r_place, place[new]]), np.concatenate([r_n, np.ones(new.sum(), np.int64)]),
            ], names)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of new documents that are not the first of their kind; rows come sorted."""
    names = [c.split()[0] for c in REPEAT.split(", ")]
    before = None
    for batch in batches:
        kind, start, gram, fresh, doc, place, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        passed = kind == 0
        out = [[c[passed] for c in (doc, place, n)]]
        start, gram, fresh, doc, place = (c[~passed] for c in (start, gram, fresh, doc, place))
        if len(start):
            new = _changes(start, gram)
            if before is not None and (start[0], gram[0]) == before[:2]:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_doc = np.where(at >= 0, doc[at], before[2] if before is not None else 0)
            first_place = np.where(at >= 0, place[at], before[3] if before is not None else 0)
            again = ~new & fresh & ((doc != first_doc) | (place != first_place))
            before = (start[-1], gram[-1], first_doc[-1], first_place[-1])
            out.append([doc[again], place[again], np.ones(again.sum(), np.int64)])
        rows = joined(*(np.concatenate(c) for c in zip(*out)))
        if len(rows[0]):
            yield _batch(list(rows), names)


class SuffixIndex:
    """Levels of suffix arrays over the documents added so far.

    `add` takes documents that come after all earlier ones (columns doc, tag, text); `repeats` then
    gives the repeats in the documents added since it was last called: doc, place and n, for n
    windows from place on that also start earlier. Levels are tables in the shared folder; the two
    tables of a merge are deleted after it.
    """

    def __init__(self, spark: SparkSession):
        self.steps = Steps(spark)
        self.partitions = shuffle_partitions(spark)
        self.levels: list[tuple[int, DataFrame, str]] = []  # batches in it, entries, their folder
        self.scans: list[DataFrame] = []  # since `repeats` was last called
        self.seen: int | None = None  # the largest id when `repeats` was last called
        self.last: int | None = None  # the largest id

    def merge_levels(self) -> None:
        """Merge the two smallest levels as long as they are equal in size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, a_folder), (_, b, b_folder) = self.levels.pop(), self.levels.pop()
            both = a.unionByName(b).repartition(self.partitions, "start").sortWithinPartitions("start", "run")
            self.levels.append((2 * size, self.steps.write(both, "level"), self.steps.latest))
            self.steps.remove(a_folder)
            self.steps.remove(b_folder)

    def add(self, docs: DataFrame, last: int | None = None) -> None:
        """Merge-scan the suffix array of a batch with all levels, and make it a level.

        `last` is the largest id that the batch may have; it is needed if more batches follow a
        call of `repeats`.
        """
        self.merge_levels()
        self.last = last
        rows = docs.select("doc", "tag", "text").mapInArrow(_sampled, ENTRY)
        for _, level, _ in self.levels:
            rows = rows.unionByName(level.withColumn("kind", F.lit(2)))
        order = ["start", "run", F.col("kind").desc(), "doc", "place"]
        sorted_rows = rows.repartition(self.partitions, "start").sortWithinPartitions(*order)
        scanned = self.steps.write(sorted_rows.mapInArrow(_scanned, ENTRY), "scanned", ["kind"])
        fresh = scanned.filter("kind = 1").select("start", "run", "doc", "place", "n")
        self.levels.append((1, fresh, f"{self.steps.latest}/kind=1"))
        self.scans.append(scanned)

    def drop_levels(self) -> None:
        """Delete the levels; no more batches can be added."""
        for _, _, folder in self.levels:
            self.steps.remove(folder)
        self.levels = []

    def repeats(self, texts: DataFrame) -> DataFrame:
        """Takes doc, tag, text of all documents added. Compares the windows of the probes."""
        scans, self.scans = self.scans, []
        scanned = scans[0]
        for more in scans[1:]:
            scanned = scanned.unionByName(more)
        probes = scanned.filter("kind in (3, 4)").groupBy("doc", F.shiftright("place", TAG).alias("tag")).agg(
            F.collect_set(F.struct("start", "place", "n")).alias("probes")
        )
        fresh = F.lit(True) if self.seen is None else F.col("doc") > self.seen
        self.seen = self.last
        rows = texts.join(probes, ["doc", "tag"]).select("doc", "tag", "text", "probes", fresh.alias("fresh"))
        dealt = rows.mapInArrow(_grams, GRAM).repartition(self.partitions, "start").sortWithinPartitions(
            "start", "gram", "fresh", "doc", "place"
        )
        partial = self.steps.write(dealt.mapInArrow(_repeated, REPEAT), "repeats")
        return scanned.filter("kind = 0").select("doc", "place", "n").unionByName(partial)


def find_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc, place, n: windows of 100 bytes that also start earlier, from doc, tag and text."""
    index = SuffixIndex(docs.sparkSession)
    borders = range_borders(docs, "doc", batches)
    for i in range(len(borders) + 1):
        upper = F.col("doc") < borders[i] if i < len(borders) else F.lit(True)
        lower = F.col("doc") >= borders[i - 1] if i else F.lit(True)
        index.add(docs.filter(lower & upper), borders[i] - 1 if i < len(borders) else None)
    index.drop_levels()
    return index.repeats(docs)


def _removed(size: int, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of a text's bytes the windows of repeats cover, and in how many stretches."""
    _, begin, n = joined(np.zeros(len(begin), np.int64), begin, n + WINDOW - 1)
    edge = np.zeros(size + 1, np.int8)  # stretches are apart, so a byte is covered once at most
    edge[begin] += 1
    edge[begin + n] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool), len(begin)


def _cut(as_text: bool):
    """Texts without the bytes of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            repeats = batch.column("repeats")
            rows = repeats.flatten()
            place, n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n"))
            last = np.cumsum(repeats.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            removed, spans, kept = [], [], []
            for i, tag in enumerate(batch.column("tag").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                own = slice(last[i - 1] if i else 0, last[i])
                gone, stretches = np.zeros(0, bool), 0
                if own.start < own.stop:
                    gone, stretches = _removed(len(text), place[own] - (tag << TAG), n[own])
                removed.append(int(gone.sum()))
                spans.append(stretches)
                rest = (text[~gone] if stretches else text).tobytes()
                kept.append(rest.decode(errors="ignore") if as_text else rest)
            counts = [pa.array(c, pa.int64()) for c in (np.diff(offsets), removed, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *counts, pa.array(kept, pa.string() if as_text else pa.binary())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, as_text: bool = False,
) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept per row, where `keep` is the column to carry as `row`.

    Each byte goes that is covered by a string of 100 bytes which also starts earlier: in a document
    with a smaller id, or earlier in the same one. Matches are judged on the input and never cross
    documents. `kept` has the other bytes, with `as_text` as a string without the rests of cut
    characters. Null texts are empty; null ids count as the smallest. Equal rows with the same id
    are the same document; rows that repeat an id with other texts are ordered by a hash of the
    text. An empty table gives no rows; other columns are only carried. Equal strings are told by
    64-bit hashes.

    Texts are shuffled by id twice: for the comparison of windows and for the removal.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NONE)).alias("doc"),
        F.pmod(F.xxhash64(text), F.lit(TAGS)).alias("tag"), text.alias("text"), keep.alias("row"),
    )
    repeats = find_repeats(rows.select("doc", "tag", "text"), batches).groupBy("doc", F.shiftright("place", TAG).alias("tag")).agg(
        F.collect_list(F.struct("place", "n")).alias("repeats")
    )
    schema = T.StructType([
        rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])
    joined_rows = rows.join(repeats, ["doc", "tag"], "left").select("row", "tag", "text", "repeats")
    return joined_rows.mapInArrow(_cut(as_text), schema)


def drop_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without their repeats, with all columns; n_chars is counted anew."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cut = remove_repeats(docs, row, batches=batches, as_text=True)
    out = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
