"""Hard negatives: for an anchor and its best positives, the best other-label rows in a window of scores.

Scores are inner products. With one more component, sqrt(M - |x|^2) for a row and 0 for an
anchor, M the largest squared length, a score is a distance: d^2 = |q|^2 + M - 2 * score. So
a window of scores is an annulus around the anchor, and rows can be kept in a tree for metric
spaces. A node of the tree has split points; a row belongs to the nearest one. For every two
split points the node stores the range of distances from the first to all rows below the
second. An anchor's annulus turns, by the triangle inequality, into a range around each split
point, and a subtree whose stored range misses it for any split point is passed over. Leaves
that remain are scanned in full, so the result is exact whatever the tree looks like.

Split points come from a bounded sample; every row is indexed and every range covers all rows
below it. The sample also bounds from below what the last wanted score will be, which makes
the annuli thin. Leaves are cut into parts of bounded size, and the anchors that visit a leaf
into blocks, so that a crowded leaf or a large group of copies is shared by many tasks.

Rows with a null id, label or vector, or with any null or non-finite component, take no part;
nor does a vector whose squared length is beyond a double. Vectors of unequal length are
filled up with zeros. Rows that repeat are rows of their own, but never negatives or positives
of an anchor with their id; of several rows with an anchor's id the least (label, vector) is
the anchor. Scores are exact below 2^53. No rows or anchors give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solekey.llm.frames import BROADCAST_ROWS, map_batches
from solekey.session import durable

# Rows the driver looks at to choose split points and first bounds, and their cells at most.
SAMPLE_ROWS = 20_000
SAMPLE_CELLS = 4_000_000

# Rows a leaf should hold, until the tree has its largest number of split points in a node.
LEAF_ROWS = 800
MAX_FAN = 64
DEPTH = 2

# Rows of a leaf's part and anchors of a block, the most that one task compares at a time.
PART_ROWS = 1024
BLOCK_ANCHORS = 1024

# Anchors that walk the tree together.
WALKERS = 128


def matrix(column: pa.Array, dim: int, scale: float | None) -> np.ndarray:
    """A list column as floor(scale * x), or as it is; short rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = values
    return out if scale is None else np.floor(scale * out)


@dataclass
class Node:
    """Split points, what is below each, and from each the range of distances to all below another."""

    points: np.ndarray
    below: list  # a Node, or the number of a leaf
    low: np.ndarray
    high: np.ndarray
    number: int


class Tree:
    """Nodes over rows of squared length at most ``top``, in the space with one more component."""

    def __init__(self, sample: np.ndarray, top: float, fan: int, depth: int = DEPTH):
        self.top = top
        self.slack = 1e-5 * np.sqrt(top) + 1e-9
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(self.lifted(sample), fan, depth)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", rows, rows), 0))
        return np.hstack([rows, rest[:, None]])

    def _grow(self, sample: np.ndarray, fan: int, depth: int):
        chosen = self._spread(sample, fan) if depth else []
        if len(chosen) < 2:
            self.leaves += 1
            return self.leaves - 1
        m = len(chosen)
        node = Node(sample[chosen], [], np.full((m, m), np.inf), np.full((m, m), -np.inf), len(self.nodes))
        self.nodes.append(node)
        nearest = self._apart(sample, node.points).argmin(axis=1)
        node.below = [self._grow(sample[nearest == j], fan, depth - 1) for j in range(m)]
        return node

    def _spread(self, sample: np.ndarray, fan: int) -> list[int]:
        """Of three times as many rows, those that lie farthest from the ones chosen before."""
        pool = sample[: 3 * fan]
        if not len(pool):
            return []
        chosen, gap = [0], self._apart(pool, pool[:1])[:, 0]
        while len(chosen) < fan and gap.max() > self.slack:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, self._apart(pool, pool[chosen[-1:]])[:, 0])
        return chosen

    def _apart(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances between lifted rows; all of them have squared length ``top``."""
        return np.sqrt(np.maximum(2 * (self.top - rows @ points.T), 0))

    def place(self, rows: np.ndarray, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The leaf of every row; widens ``ranges`` (node: lows and highs) by these rows."""
        leaf = np.zeros(len(rows), np.int32)
        todo = [(self.root, np.arange(len(rows)))]
        lifted = self.lifted(rows)
        while todo:
            node, members = todo.pop()
            if not isinstance(node, Node):
                leaf[members] = node
                continue
            apart = self._apart(lifted[members], node.points)
            nearest = apart.argmin(axis=1)
            low, high = ranges.setdefault(
                node.number, (np.full_like(node.low, np.inf), np.full_like(node.high, -np.inf))
            )
            for j, child in enumerate(node.below):
                mine = nearest == j
                if mine.any():
                    low[:, j] = np.minimum(low[:, j], apart[mine].min(axis=0))
                    high[:, j] = np.maximum(high[:, j], apart[mine].max(axis=0))
                    todo.append((child, members[mine]))
        return leaf

    def radius(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance (anchor, window) at which a row has the score; ``scores`` has the same shape."""
        length = np.einsum("ij,ij->i", anchors, anchors)
        return np.sqrt(np.maximum(length[:, None] + self.top - 2 * scores, 0))

    def reached(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) pairs where a row may lie in one of the anchor's annuli inner..outer."""
        whose, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        length = np.einsum("ij,ij->i", anchors, anchors)[:, None]
        todo = [(self.root, np.arange(len(anchors)), inner, outer)]
        while todo:
            node, members, a, b = todo.pop()
            if not isinstance(node, Node):
                whose.append(members)
                leaves.append(np.full(len(members), node))
                continue
            scores = anchors[members] @ node.points[:, :-1].T
            apart = np.sqrt(np.maximum(length[members] + self.top - 2 * scores, 0))
            alive = np.broadcast_to((a <= b)[:, :, None], (*a.shape, len(node.below))).copy()
            for i in range(len(node.below)):
                at = apart[:, i, None]
                nearest, farthest = np.maximum(a - at, at - b) - self.slack, at + b + self.slack
                alive &= (node.low[i] <= farthest[:, :, None]) & (node.high[i] >= nearest[:, :, None])
            for j, child in enumerate(node.below):
                on = alive[:, :, j].any(axis=1)
                if on.any():
                    todo.append((child, members[on], a[on], np.where(alive[on][:, :, j], b[on], -1.0)))
        return np.concatenate(whose), np.concatenate(leaves)


@dataclass
class Sample:
    """Rows of the table that the driver holds; the scores they reach are bounds for those of all rows."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray

    def nth_positive(self, ids, labels, anchors, n: int) -> np.ndarray:
        """For each anchor a score that ``n`` same-label rows reach, or -inf."""
        scores = anchors @ self.rows.T
        own = (labels[:, None] == self.labels) & (ids[:, None] != self.ids)
        return _nth(np.where(own, scores, -np.inf), n)

    def nth_negative(self, labels, anchors, low, high, n: int) -> np.ndarray:
        """For each anchor and window a score in it that ``n`` other-label rows reach, or -inf."""
        scores = anchors @ self.rows.T
        scores = np.where(labels[:, None] != self.labels, scores, -np.inf)
        inside = lambda w: (scores >= low[:, w, None]) & (scores <= high[:, w, None])
        return np.stack([_nth(np.where(inside(w), scores, -np.inf), n) for w in range(low.shape[1])], axis=1)


def _nth(scores: np.ndarray, n: int) -> np.ndarray:
    if scores.shape[1] < n:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, -n, axis=1)[:, -n]


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n``: highest score, then least id."""
    if len(scores) > 4 * n:
        near = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector").dropna()
    return kept.where(~F.exists("vector", bad))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    scale: float | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, vector``; other columns are left out. ``is_anchor`` is a
    condition on ``vec_id``. An anchor's positives are its ``n_positives`` best other rows of
    the same label; for each, the ``n_negatives`` best rows of another label are returned whose
    score is between ``least_percent`` and ``most_percent`` of the positive's. Ties go to the
    smaller id. With ``scale``, components are floor(scale * x).
    """
    spark = rows.sparkSession
    rows = _usable(rows)
    n_rows, top, dim = _measure(rows, scale)
    if not n_rows:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"
        return spark.createDataFrame([], empty)
    sample = _draw(rows, n_rows, dim, scale)
    fan = int(np.clip(np.ceil((n_rows / LEAF_ROWS) ** (1 / DEPTH)), 2, MAX_FAN))
    tree = Tree(sample.rows, top, fan)
    indexed = durable(_index(rows, spark.sparkContext.broadcast(tree), dim, scale))
    _set_ranges(tree, indexed, dim, scale)
    shared = spark.sparkContext.broadcast((tree, sample))

    least = F.min(F.struct("label", "vector")).alias("one")
    anchors = rows.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(least).select("anchor_id", "one.*")
    anchors = durable(anchors)
    positives = _positives(anchors, indexed, shared, n_positives, dim, scale)
    ordered = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    positives = positives.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= n_positives)
    wanted = positives.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives")
    )
    wanted = durable(anchors.join(wanted, "anchor_id"))
    found = _negatives(wanted, indexed, shared, n_negatives, least_percent, most_percent, dim, scale)
    ordered = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= n_negatives)
    positive = F.col("positives")[F.col("place") - 1]
    return found.join(wanted.select("anchor_id", "positives"), "anchor_id").select(
        "anchor_id",
        positive["positive_id"].alias("positive_id"),
        "rank",
        "negative_id",
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def _measure(rows: DataFrame, scale) -> tuple[int, float, int]:
    """Rows, largest squared length and largest number of components."""

    def run(batches):
        n, top, dim = 0, 0.0, 0
        for batch in batches:
            if batch.num_rows:
                width = int(np.max(batch.column(0).value_lengths().to_numpy(zero_copy_only=False), initial=0))
                x = matrix(batch.column(0), width, scale)
                n, top, dim = n + len(x), max(top, np.einsum("ij,ij->i", x, x).max()), max(dim, width)
        yield pa.RecordBatch.from_pydict({"n": [n], "top": [top], "dim": [dim]})

    parts = map_batches(rows.select("vector"), run, "n long, top double, dim long")
    row = parts.agg(F.sum("n"), F.max("top"), F.max("dim")).first()
    return int(row[0] or 0), float(row[1] or 0.0), int(row[2] or 0)


def _draw(rows: DataFrame, n_rows: int, dim: int, scale) -> Sample:
    size = min(SAMPLE_ROWS, max(MAX_FAN * MAX_FAN, SAMPLE_CELLS // max(1, dim)))
    drawn = rows.where(F.rand(5) < 1.2 * size / n_rows).orderBy(F.rand(6)).limit(size).toArrow()
    column = drawn.column("vector").combine_chunks()
    return Sample(
        drawn.column("vec_id").to_numpy(), drawn.column("label").to_numpy(), matrix(column, dim, scale)
    )


def _index(rows: DataFrame, tree, dim: int, scale) -> DataFrame:
    """``leaf, salt, vec_id, label, vector``: the leaf of every row, and a number that deals rows evenly."""

    def run(batches):
        at = 0
        for batch in batches:
            leaf = tree.value.place(matrix(batch.column("vector"), dim, scale), {})
            salt = np.arange(at, at + len(leaf))
            at += len(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(salt), *batch.columns], ["leaf", "salt", *batch.schema.names])

    kind = rows.schema["vector"].dataType.simpleString()
    return map_batches(rows, run, f"leaf int, salt long, vec_id long, label long, vector {kind}")


def _set_ranges(tree: Tree, indexed: DataFrame, dim: int, scale) -> None:
    """Ranges over all rows; their number is bounded by the split points of the tree."""
    bare = indexed.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        ranges: dict = {}
        for batch in batches:
            bare.value.place(matrix(batch.column(0), dim, scale), ranges)
        for number, (low, high) in ranges.items():
            i, j = np.nonzero(low <= high)
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([number] * len(i), pa.int32()), "i": i, "j": j, "low": low[i, j], "high": high[i, j]}
            )

    parts = map_batches(indexed.select("vector"), run, "node int, i long, j long, low double, high double")
    merged = parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    node, i, j, low, high = (merged.column(c).to_numpy() for c in ("node", "i", "j", "low", "high"))
    for own in tree.nodes:
        of = node == own.number
        own.low[i[of], j[of]], own.high[i[of], j[of]] = low[of], high[of]


def _scan(rows: DataFrame, visits: DataFrame, keys: list[str], compare, schema: str) -> DataFrame:
    """``compare(rows, visits)`` on every part of a group's rows and every block of its visitors."""
    n_rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    n_asks = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_asks"))
    cells = n_rows.join(n_asks, keys).select(
        *keys,
        F.ceil(F.col("n_rows") / PART_ROWS).cast("int").alias("parts"),
        F.ceil(F.col("n_asks") / BLOCK_ANCHORS).cast("int").alias("blocks"),
    )
    cells = durable(cells)
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod("salt", n).cast("int")
    left = rows.join(cells, keys).withColumns({"part": dealt("parts"), "block": number("blocks")})
    right = visits.join(cells, keys).withColumns({"part": number("parts"), "block": dealt("blocks")})
    by = [*keys, "part", "block"]
    left, right = left.drop("salt", "parts", "blocks"), right.drop("salt", "parts", "blocks")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, schema)


def _positives(anchors, indexed, shared, n: int, dim: int, scale) -> DataFrame:
    """The best ``n`` of each part of the leaves that may hold one of an anchor's positives."""

    def walk(batches):
        tree, sample = shared.value
        at = 0
        for batch in _small(batches):
            ids, labels = batch.column("anchor_id").to_numpy(), batch.column("label").to_numpy()
            q = matrix(batch.column("vector"), dim, scale)
            least = sample.nth_positive(ids, labels, q, n)[:, None]
            whose, leaf = tree.reached(q, np.zeros_like(least), tree.radius(q, least))
            yield _visits(batch, whose, leaf, at, least=least[whose, 0])
            at += len(whose)

    def compare(rows, asks):
        if not rows.num_rows or not asks.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = rows.column("vec_id").to_numpy()
        anchors, least = asks.column("anchor_id").to_numpy(), asks.column("least").to_numpy()
        scores = matrix(asks.column("vector"), dim, scale) @ matrix(rows.column("vector"), dim, scale).T
        out = ([], [], [])
        for k, anchor in enumerate(anchors):
            ok = np.flatnonzero((ids != anchor) & (scores[k] >= least[k]))
            ok = ok[_best(scores[k, ok], ids[ok], n)]
            for column, values in zip(out, (np.full(len(ok), anchor), ids[ok], scores[k, ok])):
                column.append(values)
        return pa.table(dict(zip(("anchor_id", "positive_id", "score"), map(np.concatenate, out))))

    kind = anchors.schema["vector"].dataType.simpleString()
    visits = map_batches(anchors, walk, f"leaf int, salt long, anchor_id long, label long, vector {kind}, least double")
    return _scan(indexed, durable(visits), ["leaf", "label"], compare, "anchor_id long, positive_id long, score double")


def _negatives(wanted, indexed, shared, n: int, least_percent: int, most_percent: int, dim: int, scale) -> DataFrame:
    """The best ``n`` in each window of each part of the leaves that may hold one."""

    def windows(column):
        """Positives' scores, a column for each place; an anchor with fewer has empty windows."""
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        scores, lengths = lists.flatten().field("score").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
        out = np.full((len(lengths), int(lengths.max(initial=1))), -1.0)
        out[np.arange(out.shape[1]) < lengths[:, None]] = scores
        return out

    def walk(batches):
        tree, sample = shared.value
        at = 0
        for batch in _small(batches):
            labels, q = batch.column("label").to_numpy(), matrix(batch.column("vector"), dim, scale)
            positive = windows(batch.column("positives"))
            low, high = least_percent * positive / 100, most_percent * positive / 100
            least = sample.nth_negative(labels, q, low, high, n)
            inner, outer = tree.radius(q, high), tree.radius(q, np.maximum(low, least))
            inner, outer = np.maximum(inner - tree.slack, 0), outer + tree.slack
            outer = np.where(low <= high, outer, -1.0)  # a negative score has an empty window
            whose, leaf = tree.reached(q, inner, outer)
            yield _visits(batch, whose, leaf, at, least=pa.array(list(least[whose]), pa.list_(pa.float64())))
            at += len(whose)

    def compare(rows, asks):
        names = ("anchor_id", "place", "negative_id", "score")
        out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if rows.num_rows and asks.num_rows:
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            anchors, own = asks.column("anchor_id").to_numpy(), asks.column("label").to_numpy()
            scores = matrix(asks.column("vector"), dim, scale) @ matrix(rows.column("vector"), dim, scale).T
            positive, least = windows(asks.column("positives")), asks.column("least").to_pylist()
            for k, anchor in enumerate(anchors):
                other = np.flatnonzero(labels != own[k])
                score = scores[k, other]
                for w, p in enumerate(positive[k]):
                    ok = (least_percent * p <= 100 * score) & (100 * score <= most_percent * p)
                    if w < len(least[k]):
                        ok &= score >= least[k][w]
                    ok = np.flatnonzero(ok)
                    ok = ok[_best(score[ok], ids[other[ok]], n)]
                    values = (np.full(len(ok), anchor), np.full(len(ok), w + 1, np.int32), ids[other[ok]], score[ok])
                    for column, part in zip(out, values):
                        column.append(part)
        return pa.table(dict(zip(names, map(np.concatenate, out))))

    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("anchor_id", "label", "vector", "positives"))
    visits = map_batches(wanted.select("anchor_id", "label", "vector", "positives"), walk, f"leaf int, salt long, {kinds}, least array<double>")
    schema = "anchor_id long, place int, negative_id long, score double"
    return _scan(indexed, durable(visits), ["leaf"], compare, schema)


def _small(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, WALKERS):
            yield batch.slice(at, WALKERS)


def _visits(batch: pa.RecordBatch, whose: np.ndarray, leaf: np.ndarray, at: int, least) -> pa.RecordBatch:
    """One row for each visit of an anchor to a leaf."""
    taken = batch.take(pa.array(whose))
    salt = pa.array(np.arange(at, at + len(whose)))
    columns = [pa.array(leaf.astype(np.int32)), salt, *taken.columns, pa.array(least) if isinstance(least, np.ndarray) else least]
    return pa.RecordBatch.from_arrays(columns, ["leaf", "salt", *taken.schema.names, "least"])
