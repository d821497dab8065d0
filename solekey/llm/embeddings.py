"""Near-duplicate vectors by an inverted multi-index: two codebooks, a grid of cells, exact checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.components import components
from solekey.llm.frames import drawn, map_batches
from solekey.session import durable

MIN_COSINE = 0.95

# Codebooks are fitted, and the traversal's reach is set, on about so many vectors at most.
SAMPLE_ROWS = 20_000

# Share of pairs just at the least cosine that the traversal of one side must reach, measured on
# vectors the codebooks were not fitted on. A pair is found if either side reaches the other, so
# the recall of pairs is higher still.
TARGET_RECALL = 0.9

# Part of the sample that codebooks are not fitted on, and rows compared with all words at a time.
HELD_OUT = 0.2
SLICE = 1000

# Vectors of a cell aimed at, and codewords of a half at most (2 x 4096 words are broadcast).
PER_CELL, MOST_WORDS = 16, 4096

# Members of a cell, and visitors to it, that meet in one group; fuller cells are split by both.
BLOCK, VISITORS = 2048, 8192


@dataclass
class MultiIndex:
    """Codebooks for both halves of unit vectors, and the slack up to which cells are visited."""

    width: int
    words: tuple[np.ndarray, np.ndarray]
    slack: float = 0.0

    def halves(self, rows: np.ndarray):
        cut = (self.width + 1) // 2
        return rows[:, :cut], rows[:, cut:]

    def distances(self, rows: np.ndarray):
        """Squared distances of the halves of each row to all words of their codebooks."""
        return [
            (part**2).sum(1)[:, None] - 2 * part @ words.T + (words**2).sum(1)[None, :]
            for part, words in zip(self.halves(rows), self.words)
        ]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(rows), SLICE):
            first, second = self.distances(rows[at : at + SLICE])
            out.append(first.argmin(1) * len(self.words[1]) + second.argmin(1))
        return np.concatenate(out)

    def visits(self, rows: np.ndarray):
        """For each row the cells from the nearest on, while their distance is within the slack.

        Both lists of words are sorted by distance; the cells of a row are the pairs of ranks
        whose sum of distances exceeds the least by no more than the slack.
        """
        first, second = self.distances(rows)
        a, b = first - first.min(1, keepdims=True), second - second.min(1, keepdims=True)
        for x, y in zip(a, b):
            i, j = np.flatnonzero(x <= self.slack), np.flatnonzero(y <= self.slack)
            total = x[i][:, None] + y[j][None, :]
            p, q = np.nonzero(total <= self.slack)
            order = np.argsort(total[p, q], kind="stable")
            yield i[p[order]] * len(self.words[1]) + j[q[order]]

    def excess(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell each of ``cells`` is from each row."""
        first, second = self.distances(rows)
        i, j = np.divmod(cells, len(self.words[1]))
        return (first[:, i] - first.min(1, keepdims=True)) + (second[:, j] - second.min(1, keepdims=True))


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from a spread of distinct rows; an empty word keeps its place."""
    rng = np.random.default_rng(7)
    words = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        norm = (words**2).sum(1)[None, :]
        near = np.concatenate([(norm - 2 * part @ words.T).argmin(1) for part in np.split(rows, range(SLICE, len(rows), SLICE))])
        count = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, rows)
        words[count > 0] = total[count > 0] / count[count > 0][:, None]
    return words


def fit(sample: np.ndarray, n_rows: int, min_cosine: float = MIN_COSINE) -> MultiIndex:
    """Codebooks from a sample of unit vectors, sized by the number of rows to index.

    The slack is the least with which a vector visits the cell of a partner at the least cosine
    in ``TARGET_RECALL`` of the cases, for partners drawn in random directions and for those that
    vectors of the sample have in it. Both are measured on vectors held out of the codebooks.
    """
    k = int(min(MOST_WORDS, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n_rows / PER_CELL)))))))
    width = sample.shape[1]
    rng = np.random.default_rng(11)
    mixed = sample[rng.permutation(len(sample))]
    held_out = int(len(mixed) * HELD_OUT)
    fitted, some = mixed[held_out:], mixed[:held_out][:4000] if held_out else mixed
    index = MultiIndex(width, (np.zeros((1, (width + 1) // 2)), np.zeros((1, width // 2))))
    index.words = tuple(k_means(part, min(k, len(part))) for part in index.halves(fitted))
    aside = rng.standard_normal(some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    partners = min_cosine * some + np.sqrt(1 - min_cosine**2) * aside
    cells, homes = index.cells(partners), index.cells(mixed)
    reach, held = [], []
    for i, one in enumerate(some):  # the held-out vectors stand first in `mixed`
        near = np.flatnonzero(mixed @ one >= min_cosine) if i < 500 else np.zeros(0, int)
        near = near[near != i]
        excess = index.excess(one[None, :], np.concatenate([cells[i : i + 1], homes[near]]))[0]
        reach.append(excess[0])
        held.extend(excess[1:])
    index.slack = max(float(np.quantile(x, TARGET_RECALL)) for x in (reach, held) if len(x)) + 1e-9
    return index


def _unit(values: list, width: int) -> np.ndarray:
    rows = np.zeros((len(values), width))
    for i, x in enumerate(values):
        rows[i, : len(x)] = x
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _compare(batches, index: MultiIndex, min_cosine: float):
    """Links within groups, the blocks and parts of cells, from rows sorted by them, members first.

    For each row: how many vectors it links with, and links that join a block's linked rows.
    A pair that both sides' visits find is counted for each side where it is the visitor; else
    the visited side is counted here, too.
    """
    current, members = None, None
    counts: dict[int, int] = {}

    def flush(rows):
        if rows:
            a, b, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "part"))))
        role = batch.column("visitor").to_numpy(zero_copy_only=False)
        home = batch.column("home").to_numpy()
        ids, dims, copies = (batch.column(c).to_numpy() for c in ("class", "dims", "copies"))
        vectors = _unit(batch.column("embedding").to_pylist(), index.width)
        rows: list[tuple] = []
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at] and role[end] == role[at]:
                end += 1
            if keys[at] != current:
                current, members = keys[at], None
            part = slice(at, end)
            if not role[at]:
                own = (ids[part], dims[part], copies[part], vectors[part], home[part])
                members = own if members is None else tuple(np.concatenate(x) for x in zip(members, own))
                label = np.arange(len(members[0]))
            elif members is not None:
                near = (vectors[part] @ members[3].T >= min_cosine) & (dims[part][:, None] == members[1][None, :])
                near &= ids[part][:, None] != members[0][None, :]
                linked = np.flatnonzero(near.any(0))
                if len(linked):
                    back = np.zeros(near.shape, bool)
                    back[:, linked] = (index.excess(members[3][linked], home[part]) <= index.slack).T
                    for i in np.flatnonzero(near.any(1)).tolist():
                        here = np.flatnonzero(near[i])
                        one = int(ids[part][i])
                        rows.append((one, int(members[0][here[0]]), int(members[2][here].sum())))
                        for j in here[~back[i, here]].tolist():
                            counts[int(members[0][j])] = counts.get(int(members[0][j]), 0) + int(copies[part][i])
                        roots = np.unique(label[here])
                        if len(roots) > 1:
                            rows += [(one, int(members[0][r]), 0) for r in roots.tolist()]
                            label[np.isin(label, roots)] = roots[0]
            at = end
        rows += [(k, None, n) for k, n in counts.items()]
        counts.clear()
        yield from flush(rows)


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Two rows link if the cosine of their vectors, in double precision, is ``min_cosine`` or more;
    ``n_links`` counts a row's linked rows, ``component_id`` is the smallest ``vec_id`` reachable
    by links, and a row is kept if that is its own. Vectors of different lengths never link; a
    vector that is null, empty or zero, or that holds null or non-finite components, links with
    nothing. Equal vectors are one class with a count, so that copies make no pairs; repeated
    rows count each. A null ``vec_id`` names nothing (its component is null if no row of it has
    an id). An empty table gives an empty result; other columns are ignored.

    The index is fitted on a bounded sample and holds every vector: each class stands in the
    cell of its nearest codewords and visits the cells within its reach. Visitors meet members
    in groups of bounded size on both sides and only counts and links that join are sent on,
    never all pairs.
    """
    rows = durable(
        vectors.select("vec_id", "embedding").withColumn("fit", _usable(F.col("embedding")))
    )
    classes = durable(
        rows.where("fit")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("class", F.monotonically_increasing_id())
        .withColumn("dims", F.size("embedding"))
    )
    n_rows, width = classes.agg(F.count(F.lit(1)), F.max("dims")).first()
    alone = rows.where("NOT fit").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    if not n_rows:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    share = min(1.0, sample_rows / n_rows)
    chosen = classes.where(drawn(F.xxhash64("embedding"), share)).select("embedding").collect()
    sample = _unit([r.embedding for r in chosen] or [classes.first().embedding], width)
    index = classes.sparkSession.sparkContext.broadcast(fit(sample, n_rows, min_cosine))

    def place(batches):
        for batch in batches:
            unit = _unit(batch.column("embedding").to_pylist(), width)
            homes = index.value.cells(unit)
            visits = [v.tolist() for v in index.value.visits(unit)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(homes, pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                [*batch.schema.names, "home", "visits"],
            )

    # Vectors travel in the type they have; cosines are computed in double precision.
    kind = classes.schema["embedding"].dataType.simpleString()
    own = classes.select("class", "copies", "dims", "embedding")
    placed = durable(
        map_batches(own, place, f"class long, copies long, dims int, embedding {kind}, home long, visits array<long>")
    )
    # Every class visits its own cell, so each cell with members has visitors.
    crowd = (
        placed.groupBy(F.col("home").alias("cell"))
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        .join(
            placed.select(F.explode("visits").alias("cell"))
            .groupBy("cell")
            .agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts")),
            "cell",
        )
    )
    columns = ["cell", "block", "part", "visitor", "home", "class", "dims", "copies", "embedding"]
    # A member stands in one block, in all its parts; a visitor comes to all blocks, in one part.
    members = placed.join(crowd, F.col("home") == F.col("cell")).select(
        "*",
        F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("visitor"),
    )
    visitors = (
        placed.select("home", "class", "dims", "copies", "embedding", F.explode("visits").alias("cell"))
        .join(crowd, "cell")
        .select(
            "*",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("class", F.lit("visitor")), F.col("parts")).cast("int").alias("part"),
            F.lit(True).alias("visitor"),
        )
    )
    met = (
        members.select(*columns)
        .unionByName(visitors.select(*columns))
        .repartition("cell", "block", "part")
        .sortWithinPartitions("cell", "block", "part", "visitor")
    )
    found = durable(
        map_batches(met, lambda batches: _compare(batches, index.value, min_cosine), "a long, b long, n long")
    )
    counted = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("class"), "component")
    named = (
        classes.join(counted, "class", "left")
        .join(groups, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = named.join(smallest, "component").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = rows.where("fit").join(result, "embedding").select("vec_id", "n_links", "component_id")
    everything = linked.unionByName(alone)
    return everything.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _usable(embedding):
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))
