"""Hard negatives by inner product, found with cover trees over norm-augmented vectors.

A component is added to each candidate so that all get the norm of the longest, and a 0 to each
query; nearness in the augmented space is then the order of inner products. The first level of the
tree are the cells of pivots; a cell is cut into parts of bounded size, and each part is a cover
tree of its own: below a node, centres are chosen that are farther apart than the radius of their
level, which shrinks from level to level, and each point goes to a centre within it. A node keeps
the real distance to the farthest point below it, so an inner product with any of these is bounded
by that with the centre. A search goes down level by level, leaves out nodes whose bounds miss the
windows asked for, then verifies leaves in descending order of their nodes' bounds until none can
come among the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Steps, shuffle_partitions
from spanloom.llm.vectors import dealt, integer_vector, matrix, meet

POSITIVES = 5  # of an anchor
NEGATIVES = 5  # of an anchor and a positive
LEAST_SHARE = 80  # of the positive's score in percent, that a negative must reach
PIVOTS = 32
PIVOT_ROWS = 2048  # rows with the smallest hashes, of which pivots are chosen
PART = 2048  # vectors of a tree
BLOCK = 512  # anchors that search together
SHRINK = 1.3  # from a level's radius to the next one's
LEAF = 8  # points that a node is not split below
FIRST = 16  # nodes whose leaves are verified first; then twice as many each time

NODE = "part int, node int, parent int, level int, radius double, centre int, label bigint, ids array<bigint>, v array<bigint>"
FOUND = "q bigint, place int, id bigint, score bigint"
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def augmented(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with one more component, so that all have the square norm `largest`."""
    v = v.astype(float)
    return np.hstack([v, np.sqrt(np.maximum(largest - (v * v).sum(axis=1), 0))[:, None]])


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(points: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """parent, level, covering radius and centre of each node, parents first; a point's own node last.

    Centres are numbers of points. A node without inner structure has its points as children.
    """
    waiting = [(-1, 0, 0, np.arange(len(points)))]
    number = 0
    while waiting:
        parent, level, centre, own = waiting.pop()
        away = distances(points[own], points[centre])
        radius = float(away.max())
        yield parent, level, radius, centre
        node, number = number, number + 1
        if len(own) == 1:
            continue
        if len(own) <= LEAF or radius == 0:
            waiting += [(node, level + 1, int(i), own[j : j + 1]) for j, i in enumerate(own)]
            continue
        reach, near = radius / SHRINK, away
        while True:  # the centre itself covers first, then what is left chooses its first point
            inside = near <= reach
            waiting.append((node, level + 1, centre, own[inside]))
            own = own[~inside]
            if not len(own):
                break
            centre = int(own[0])
            near = distances(points[own], points[centre])


def _tree(largest: float, dim: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("c", "ascending")])
        v = matrix(rows.column("v"), dim)
        parent, level, radius, centre = (np.array(x) for x in zip(*cover_tree(augmented(v, largest))))
        leaf = np.bincount(parent[1:], minlength=len(parent)) == 0
        pick = pa.array(np.where(leaf, centre, -1), mask=~leaf)
        number = np.full(len(v), -1)
        number[centre[leaf]] = np.flatnonzero(leaf)
        columns = {
            "part": pa.array(np.full(len(parent), rows.column("part")[0].as_py()), pa.int32()),
            "node": pa.array(np.arange(len(parent)), pa.int32()), "parent": pa.array(parent, pa.int32()),
            "level": pa.array(level, pa.int32()), "radius": pa.array(radius), "centre": pa.array(number[centre], pa.int32()),
        }
        return pa.table(columns | {c: rows.column(c).take(pick) for c in ("label", "ids", "v")})

    return run


class Tree:
    """A cover tree read back from its nodes, for searches with many queries at once."""

    def __init__(self, nodes: pa.Table, dim: int, largest: float):
        nodes = nodes.sort_by([("node", "ascending")])
        self.largest, self.parent = largest, nodes.column("parent").to_numpy()
        self.level, self.radius = nodes.column("level").to_numpy(), nodes.column("radius").to_numpy()
        self.v = matrix(nodes.column("v"), dim).astype(float)
        self.v = self.v[nodes.column("centre").to_numpy()]
        inner = np.zeros(len(self.parent), bool)
        inner[self.parent[1:]] = True
        self.leaves = np.flatnonzero(~inner)
        # A leaf is verified with its parent; a tree of one point has the root for both.
        self.host = np.maximum(self.parent[self.leaves], 0)
        self.hosts = np.unique(self.host)
        inner[0] = True
        self.inner = inner
        self.label = nodes.column("label").take(pa.array(self.leaves)).to_numpy()
        self.ids = nodes.column("ids").combine_chunks().take(pa.array(self.leaves))
        self.first = first_of(self.ids)

    def bounds(self, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Upper bounds by query and node, minus infinity where no point below lies in the window."""
        upper = np.full((len(w), len(self.parent)), -np.inf)
        square = (w * w).sum(axis=1) + self.largest
        slack = 1e-9 * square + 1e-6
        for level in range(int(self.level[self.inner].max()) + 1):
            nodes = np.flatnonzero((self.level == level) & self.inner)
            if level:
                nodes = nodes[(upper[:, self.parent[nodes]] > -np.inf).any(axis=0)]
            if not len(nodes):
                break
            away = np.sqrt(np.maximum(square[:, None] - 2 * (w @ self.v[nodes].T), 0))
            most = (square[:, None] - np.maximum(away - self.radius[nodes], 0) ** 2) / 2 + slack[:, None]
            least = (square[:, None] - (away + self.radius[nodes]) ** 2) / 2 - slack[:, None]
            wanted = (most >= low[:, None]) & (least <= high[:, None])
            if level:
                wanted &= upper[:, self.parent[nodes]] > -np.inf
            upper[:, nodes] = np.where(wanted, most, -np.inf)
        return upper

    def search(self, w: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Query, window, leaves and scores of the first k points in each window of each query.

        `low` and `high` are queries by windows; a query's windows are looked at together.
        `allowed` says for a query which leaves count.
        """
        upper = self.bounds(w, low.min(axis=1), high.max(axis=1))[:, self.hosts]
        order = np.argsort(-upper, axis=1, kind="stable")
        place_of = np.empty_like(order)
        np.put_along_axis(place_of, order, np.arange(len(self.hosts))[None, :].repeat(len(w), 0), 1)
        bound = np.take_along_axis(upper, order, 1)
        host = np.searchsorted(self.hosts, self.host)
        active = np.flatnonzero(bound[:, 0] > -np.inf)
        found = {int(i): [(np.empty(0, int), np.empty(0)) for _ in range(low.shape[1])] for i in active}
        begin, size = 0, FIRST
        while len(active):
            end = min(begin + size, len(self.hosts))
            place = place_of[active][:, host]
            mine = (place >= begin) & (place < end) & (upper[active][:, host] > -np.inf)
            used = np.flatnonzero(mine.any(axis=0))
            used = used[np.argsort(self.first[used], kind="stable")]
            score = w[active] @ self.v[self.leaves[used]].T
            ahead = bound[active, end] if end < len(self.hosts) else np.full(len(active), -np.inf)
            going = []
            for row, i in enumerate(active.tolist()):
                own = used[mine[row, used]]
                values = score[row, mine[row, used]]
                fits = allowed(i, own)
                own, values = own[fits], values[fits]
                full = True
                for j in range(low.shape[1]):
                    inside = (values >= low[i, j]) & (values <= high[i, j])
                    before = found[i][j]
                    leaves, scores = np.concatenate([before[0], own[inside]]), np.concatenate([before[1], values[inside]])
                    if len(leaves) > k:  # whole ties stay: a class has several ids
                        least = -np.partition(-scores, k - 1)[k - 1]
                        leaves, scores = leaves[scores >= least], scores[scores >= least]
                    found[i][j] = leaves, scores
                    full &= len(scores) >= k and scores.min() > ahead[row]
                if not full and ahead[row] > -np.inf:
                    going.append(i)
            active, begin, size = np.array(going, int), end, 2 * size
        for i, windows in found.items():
            for j, (leaves, scores) in enumerate(windows):
                if len(leaves):
                    yield i, j, leaves, scores


def first_of(lists: pa.Array) -> np.ndarray:
    """The first element of each list of an array without empty ones."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.values.to_numpy()[lists.offsets.to_numpy()[:-1]]


def _searched(dim: int, largest: float, k: int, negatives: bool):
    """The first k points of a tree for each query and window: of the same label, or of others.

    Queries have q, id, c, label, v, and for negatives the windows as `scores`, the positives' own.
    """

    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        if nodes.num_rows and queries.num_rows:
            tree, w = Tree(nodes, dim, largest), matrix(queries.column("v"), dim).astype(float)
            q, own_id, label = (queries.column(c).to_numpy() for c in ("q", "id", "label"))
            if negatives:
                caps = queries.column("scores").to_pylist()
                n = max(map(len, caps))
                high = np.array([[float(x) for x in own] + [-np.inf] * (n - len(own)) for own in caps])
                low = np.where(high > -np.inf, high * LEAST_SHARE / 100 - 1e-6, np.inf)
                exact = lambda i, j, s: (100 * s >= LEAST_SHARE * high[i, j]) & (s <= high[i, j])
                allowed = lambda i, leaves: tree.label[leaves] != label[i]
            else:
                low, high = np.full((len(w), 1), -np.inf), np.full((len(w), 1), np.inf)
                exact = lambda i, j, s: np.ones(len(s), bool)
                allowed = lambda i, leaves: tree.label[leaves] == label[i]
            offsets, ids = tree.ids.offsets.to_numpy(), tree.ids.values.to_numpy()
            for i, j, leaves, scores in tree.search(w, low, high, k + 1, allowed):  # the anchor may be among them
                fits = exact(i, j, scores)
                leaves, scores = leaves[fits], scores[fits]
                n = offsets[leaves + 1] - offsets[leaves]
                each = ids[np.repeat(offsets[leaves], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                score = np.repeat(scores, n).astype(np.int64)
                if not negatives:  # an anchor is no positive of its own
                    own = np.repeat((tree.v[tree.leaves[leaves]] == w[i]).all(axis=1), n) & (each == own_id[i])
                    each, score = each[~own], score[~own]
                order = np.lexsort((each, -score))[:k]
                out.append((np.full(len(order), q[i]), np.full(len(order), j), each[order], score[order]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table({"q": columns[0], "place": columns[1].astype(np.int32), "id": columns[2], "score": columns[3]})

    return run


def _cells(pivots: np.ndarray, largest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = augmented(matrix(batch.column("v"), pivots.shape[1] - 1), largest)
            away = (pivots * pivots).sum(axis=1)[None, :] - 2 * points @ pivots.T
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(away.argmin(axis=1).astype(np.int32))], names=["c", "cell"])

    return run


def choose_pivots(classes: DataFrame, dim: int, largest: float, n: int = PIVOTS) -> np.ndarray:
    """Points far apart, each the farthest from those before, out of a bounded sample."""
    sample = classes.select("c", "v").orderBy(F.xxhash64("v"), "c").limit(PIVOT_ROWS).toArrow()
    points = augmented(matrix(sample.column("v"), dim), largest)
    chosen, away = [0], distances(points, points[0])
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[chosen[-1]]))
    return points[chosen]


def build_trees(classes: DataFrame, dim: int, largest: float, steps: Steps, part: int = PART) -> tuple[DataFrame, int]:
    """The nodes of all trees, and the number of trees. Each class is in one; a cell of very many
    classes is as many trees as it needs."""
    cells = steps.write(classes.select("c", "v").mapInArrow(_cells(choose_pivots(classes, dim, largest), largest), "c bigint, cell int"), "cells")
    sizes = {r.cell: -(-r["count"] // part) for r in cells.groupBy("cell").count().collect()}  # a row for each pivot at most
    begin, total = {}, 0
    for cell in sorted(sizes):
        begin[cell], total = total, total + sizes[cell]
    lookup = lambda own: F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.col("cell"))
    placed = cells.select("c", (lookup(begin) + F.pmod(F.xxhash64("c"), lookup(sizes))).cast("int").alias("part"))
    rows = placed.join(classes, "c").select("part", "c", "label", "ids", "v")
    n = shuffle_partitions(classes.sparkSession)
    trees = rows.repartition(n, "part").groupBy("part").applyInArrow(_tree(largest, dim), NODE)
    return steps.write(trees, "trees"), total


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, part: int = PART, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). An anchor's positives are its first other rows of the same
    label by inner product with it; for each positive, the negatives are the first rows of other
    labels whose score is at most the positive's and at least 80 percent of it. Ties go to the
    smaller id. Rows with a null id, a null label, a null vector, or null or non-finite components
    take no part; shorter vectors go on with zeros. Repeated rows count once; a row that repeats an
    id with another vector or label is a row of its own. Anchors without a positive, and positives without
    a negative, give no rows; an empty table gives none. Other columns are not read. Scores are exact where they and their sums fit 53 bits.

    Of rows with equal vector and label only those with the smallest ids can come among the first,
    so very many copies are one point of a tree. A tree and a block of anchors are what a task holds.
    """
    spark, steps = df.sparkSession, Steps(df.sparkSession)
    columns = [F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), integer_vector(F.col(vec_col), scale).alias("v")]
    rows = steps.write(
        df.select(*columns, is_anchor.alias("asks")).filter("id is not null and label is not null and v is not null")
        .groupBy("id", "label", "v").agg(F.max("asks").alias("asks")), "vectors",
    )
    most = max(positives, negatives) + 1
    place = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    shared = rows.select("id", "label", "v").withColumn("place", place).filter(F.col("place") <= most)
    classes = shared.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = steps.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    anchors = steps.write(rows.filter("asks").select(F.monotonically_increasing_id().alias("q"), "id", "label", "v"), "anchors")
    square = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    total = classes.agg(F.max(square).alias("largest"), F.max(F.size("v")).alias("dim")).first()
    n_anchors = anchors.count()
    if total.largest is None or not n_anchors:
        return spark.createDataFrame([], MINED)
    trees, parts = build_trees(classes, total.dim, total.largest, steps, part)
    blocks = -(-n_anchors // block)
    asked = anchors.withColumn("block", dealt(F.col("q"), blocks))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")

    near = meet(trees, asked, parts, blocks, _searched(total.dim, total.largest, positives, False), FOUND)
    near = near.join(anchors.select("q", F.col("id").alias("anchor_id")), "q")
    near = near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives)
    near = steps.write(near.select("q", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).alias("place")), "positives")
    windows = near.filter("positive_score >= 0").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    # Positives come in descending order, so those with a score of 0 or more are the first places.
    asked = asked.join(windows.select("q", F.col("s.positive_score").alias("scores")), "q")
    found = meet(trees, asked, parts, blocks, _searched(total.dim, total.largest, negatives, True), FOUND)
    by_score = Window.partitionBy("q", "place").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    return found.join(near, ["q", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
