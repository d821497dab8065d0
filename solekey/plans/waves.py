"""Exact answers for any number of combinations at once, one slice of the key domain after the other.

A wave reads the codes once for all combinations and looks only at keys whose hash lies in
its slice. All rows of a key are in the same slice: a repeat in a slice is a repeat of the
table, and what no slice holds the table does not hold. A combination that a wave settles is
not part of the next ones, so the first, small slice takes out most, and only those that need
it go through the whole table. The number of waves depends on no number of combinations: a
wave of more cells gets more shuffle partitions. What a wave shuffles lies on disk until it ends, so
a wave of more cells than the table has rows reads the codes once for each batch of combinations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solekey.plans import groups as G
from solekey.plans.coded import BROADCAST_ROWS, CodedTable
from solekey.plans.groups import NOTHING, Combo, Counts
from solekey.session import durable, most_cells, room, roomy

# The key domain is cut into 64 slices; waves end at these. Each makes all cells of its combinations.
SLICE_BITS = 6
ENDS = (1, 64)

# Repeated hashes of a combination that are looked at closely where there are too many to broadcast.
WITNESSES = 64

# Columns of which one cell says whether they follow from a part.
COLUMNS_AT_ONCE = 4

T = TypeVar("T")


def plan(table: CodedTable, n_combos: int) -> list[tuple[int, int]]:
    """Slices (first, end) of the waves; cells that fit the usual shuffle and the disk need a single one."""
    if table.n_rows * n_combos <= min(room(table.spark), most_cells(table.n_rows)):
        return [(0, ENDS[-1])]
    return list(zip((0, *ENDS), ENDS))


def batches(asked: list[T], first: int, end: int, n_rows: int) -> list[list[T]]:
    """What a wave is asked, in parts whose cells may be on disk together."""
    each = max(1, most_cells(n_rows) * ENDS[-1] // max(1, n_rows * (end - first)))
    return [asked[i : i + each] for i in range(0, len(asked), each)]


def in_slice(h: Column, first: int, end: int) -> Column:
    number = F.shiftrightunsigned(h, 64 - SLICE_BITS)
    return (number >= first) & (number < end)


def _cells_of(first: int, end: int, n_rows: int, n_combos: int) -> int:
    return n_rows * n_combos * (end - first) // ENDS[-1]


@dataclass
class Repeats:
    """Repeated keys of combinations; `counts` speak of repeated groups only.

    Combinations in `refuted` repeat, but were left before the last wave: their counts are not
    complete. `keys` are frames (combo, k0, k1, ..., size), the combination's place in the list
    as its number. `seen` has the combinations of each wave.
    """

    counts: dict[Combo, Counts]
    refuted: set[Combo] = field(default_factory=set)
    keys: list[DataFrame] = field(default_factory=list)
    seen: list[list[Combo]] = field(default_factory=list)

    def add(self, combo: Combo, more: Counts) -> None:
        old = self.counts[combo]
        self.counts[combo] = Counts(
            old.rows + more.rows,
            old.groups + more.groups,
            max(old.largest, more.largest),
            old.repeated_groups + more.repeated_groups,
            old.repeated_rows + more.repeated_rows,
        )


def repeats(
    table: CodedTable,
    combos: Sequence[Combo],
    skip_nulls: bool,
    enough: Callable[[Counts], bool],
    held: list[DataFrame],
) -> Repeats:
    """The keys that repeat, for all combinations; one with `enough` repeats is left.

    Hashes are counted first, so that keys which occur once are shuffled as one long. Cells
    whose hash repeats are found by a broadcast and grouped by their keys. Of combinations
    with more repeated hashes than can be broadcast a few are checked: one real repeat among
    them refutes the combination. Frames in use are added to `held`.
    """
    found = Repeats({c: NOTHING for c in combos})
    number = {c: i for i, c in enumerate(combos)}
    depth = G.depth_of(table.layout(combos)) if combos else 0
    still = list(combos)
    for first, end in plan(table, len(combos)):
        if not still:
            break
        found.seen.append(still)
        for batch in batches(still, first, end, table.n_rows):
            numbers, n_cells = [number[c] for c in batch], _cells_of(first, end, table.n_rows, len(batch))
            cells = G.cells(table.dealt(n_cells), table.layout(batch), skip_nulls, numbers, depth)
            hashed = cells.withColumn("h", F.xxhash64(*cells.columns)).where(in_slice(F.col("h"), first, end))
            with roomy(table.spark, n_cells):
                suspects = durable(hashed.groupBy("combo", "h").count().where(F.col("count") > 1).select("combo", "h"))
                held.append(suspects)
                per_combo = {r["combo"]: r["count"] for r in suspects.groupBy("combo").count().collect()}
                if not per_combo:
                    continue
                few, many = _split(per_combo)
                close = hashed.join(F.broadcast(_chosen(suspects, few, many)), ["combo", "h"], "left_semi").drop("h")
                counts = _count(found, close, combos, held)
                refuted = {i for i in many if counts.get(i, NOTHING).rows}
                if unclear := [i for i in many if i not in refuted]:
                    counts |= _count(found, hashed.where(F.col("combo").isin(unclear)).drop("h"), combos, held)
            found.refuted |= {combos[i] for i in refuted}
        left = [c for c in still if c not in found.refuted and not enough(found.counts[c])]
        if end < ENDS[-1]:
            found.refuted |= set(still) - set(left)
        still = left
    return found


def _split(per_combo: dict[int, int]) -> tuple[list[int], dict[int, int]]:
    """Combinations whose repeated hashes can all be broadcast together, and the others with their number."""
    few, spare = [], BROADCAST_ROWS
    for i, n in sorted(per_combo.items(), key=lambda x: x[1]):
        if n <= spare:
            few.append(i)
            spare -= n
    return few, {i: n for i, n in per_combo.items() if i not in few}


def _chosen(suspects: DataFrame, few: list[int], many: dict[int, int]) -> DataFrame:
    if not many:
        return suspects
    shares = F.create_map(*[x for i, n in many.items() for x in (F.lit(i), F.lit(WITNESSES / n))])
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(1), "h"), 11) / float(2**53)
    return suspects.where(F.col("combo").isin(few) | (drawn < F.element_at(shares, F.col("combo"))))


def _count(found: Repeats, cells: DataFrame, combos: Sequence[Combo], held: list[DataFrame]) -> dict[int, Counts]:
    keys = durable(G.sizes(cells).where(F.col("size") > 1))
    held.append(keys)
    counts = dict(enumerate(G.read_counts(G.summary(keys), len(combos))))
    for i, s in counts.items():
        if s.rows:
            found.add(combos[i], s)
    found.keys.append(keys)
    return counts


def determined(table: CodedTable, suspects: dict[Combo, list[Combo]], skip_nulls: bool) -> dict[Combo, list[Combo]]:
    """Of each combination's parts with one column less, those that determine the missing column.

    A part does not if any of its keys comes with two values of the column. Columns that may follow
    from the same part share its cells. Equal keys are combined on the map side; what a wave refutes
    is not part of the next one.
    """
    columns: dict[Combo, list[int]] = {}
    for c, parts in suspects.items():
        for p in parts:
            columns.setdefault(p, []).append(_missing(c, p))
    still = [(p, own[i : i + COLUMNS_AT_ONCE]) for p, own in columns.items() for i in range(0, len(own), COLUMNS_AT_ONCE)]
    for first, end in plan(table, len(still)):
        left = []
        for batch in batches(still, first, end, table.n_rows):
            with roomy(table.spark, _cells_of(first, end, table.n_rows, len(batch))):
                differing = _differing(table, batch, first, end, skip_nulls)
            left += [(p, [b for b in own if (p, b) not in differing]) for p, own in batch]
        still = [(p, own) for p, own in left if own]
    follows = {(p, b) for p, own in still for b in own}
    out = {c: [p for p in parts if (p, _missing(c, p)) in follows] for c, parts in suspects.items()}
    return {c: parts for c, parts in out.items() if parts}


def _missing(combo: Combo, part: Combo) -> int:
    return (set(combo) - set(part)).pop()


def _differing(
    table: CodedTable, asked: list[tuple[Combo, list[int]]], first: int, end: int, skip_nulls: bool
) -> set[tuple[Combo, int]]:
    """The parts and columns for which a key in the slices comes with two values of the column."""
    parts, values = table.layout([p for p, _ in asked]), table.layout([own for _, own in asked])
    depth, more = G.depth_of(parts), G.depth_of(values)
    layout = [(*p, *[None] * (depth - len(p)), *v, *[None] * (more - len(v))) for p, v in zip(parts, values)]
    cells = G.cells(table.dealt(_cells_of(first, end, table.n_rows, len(asked))), layout, False, depth=depth + more)
    keys, own = G.key_names(depth), G.key_names(depth + more)[depth:]
    if skip_nulls:
        cells = cells.where(_complete_parts([len(p) for p in parts]))
    # The number of a part changes from wave to wave, so its slices are those of its keys alone.
    cells = cells.where(in_slice(F.xxhash64(*keys), first, end))
    empty = _bits([F.col(k).isNull() for k in own])
    ends = [f(k).alias(f"{name}_{k}") for k in own for name, f in (("low", F.min), ("high", F.max))]
    ends = cells.groupBy("combo", *keys).agg(*ends, F.bit_and(empty).alias("all"), F.bit_or(empty).alias("some"))
    two = _bits([~F.col(f"low_{k}").eqNullSafe(F.col(f"high_{k}")) for k in own])
    two = two.bitwiseOR(F.col("all").bitwiseXOR(F.col("some"))).alias("two")
    said = ends.select("combo", two).where("two != 0").groupBy("combo").agg(F.bit_or("two").alias("two")).collect()
    found = set()
    for r in said:
        part, columns = asked[r["combo"]]
        places = [b for b in columns for _ in table.slots[b]]
        found |= {(part, b) for i, b in enumerate(places) if r["two"] >> i & 1}
    return found


def _bits(flags: Sequence[Column]) -> Column:
    """Flag i as bit i of a number."""
    return reduce(Column.bitwiseOR, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags)])


def _complete_parts(used: list[int]) -> Column:
    """No key of the part is null; keys that the part does not use are skipped."""
    sizes = F.array(*[F.lit(n) for n in used])
    ok = F.lit(True)
    for j in range(max(used)):
        ok = ok & ((F.get(sizes, F.col("combo")) <= j) | F.col(f"k{j}").isNotNull())
    return ok
