"""Agree sets of all pairs of rows that share a key, from one sort by that key.

A combination that contains a pivot can only repeat among rows that share the pivot's key.
Where such rows are few, all their pairs are compared at once on all columns. The sets of
columns they agree on decide every combination that contains the pivot, so one shuffle of
the table answers for all of these. Keys of too many rows are left out of the comparison; their
rows are written, and combinations are checked on them by grouping.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.plans import groups as G
from solekey.plans.coded import BROADCAST_ROWS, CodedTable
from solekey.plans.groups import Combo
from solekey.session import CELLS_PER_PARTITION, durable, most_cells, roomy, rows_and_largest

# Pairs of rows for each row of the table, at most, that a pivot may have.
PAIRS_PER_ROW = 64

# Keys of more rows are not compared pair by pair.
MOST_ROWS = 1_024

# Pairs are estimated on a sample of at least so many rows, and so many for each root of the table's rows.
MEASURED_FLOOR = 20_000
MEASURED_PER_ROOT = 64

# Codes that take about as much room on disk as a cell of a combination.
CODES_PER_CELL = 4

# Agree sets that a task gathers before it keeps only those that are in no other one.
MOST_SETS = 2_048

WORD = 62


def mask_of(combo: Iterable[int]) -> int:
    return sum(1 << c for c in combo)


def maximal(masks: Iterable[int]) -> list[int]:
    """The sets that are in no other one."""
    kept: list[int] = []
    for mask in sorted(set(masks), key=lambda m: (-m.bit_count(), m)):
        if not any(mask & ~other == 0 for other in kept):
            kept.append(mask)
    return kept


@dataclass
class Pivot:
    """What the rows that share a key of `combo` agree on, without keys of too many rows.

    `masks` has at least the maximal sets, and all of them if `complete`. Rows of the other
    keys are a table of their own, `rest`.
    """

    combo: Combo
    masks: set[int]
    complete: bool
    rest: CodedTable | None


class Pivots:
    def __init__(self, table: CodedTable, skip_nulls: bool):
        self.table, self.skip_nulls = table, skip_nulls
        self.found: list[Pivot] = []
        self.masks: set[int] = set()  # of all pivots
        self.pairs: dict[Combo, float] = {}  # for each row, about
        self.drawn: DataFrame | None = None

    def of(self, combo: Combo) -> Pivot | None:
        """The pivot in a combination that leaves the fewest rows open."""
        own = [p for p in self.found if set(p.combo) <= set(combo)]
        return min(own, key=lambda p: p.rest.n_rows if p.rest else 0, default=None)

    def repeats(self, combo: Combo) -> bool:
        """Some rows are known to agree on the combination."""
        mask = mask_of(combo)
        return any(mask & ~m == 0 for m in self.masks)

    def holds_all(self, combo: Combo) -> bool:
        """All agree sets that contain the combination are known."""
        return any(p.complete and p.rest is None and set(p.combo) <= set(combo) for p in self.found)

    def follows(self, part: Combo, col: int) -> bool | None:
        """Whether the column follows from the part, None if the agree sets leave that open."""
        mask, bit = mask_of(part), 1 << col
        if any(mask & ~m == 0 and not m & bit for m in self.masks):
            return False
        return True if self.holds_all(part) else None

    def choose(self, combos: Sequence[Combo]) -> Combo | None:
        """The beginning of a combination with few pairs that is in most of them, if in two or more."""
        begins = list(dict.fromkeys(c[:k] for c in combos for k in range(1, len(c) + 1)))
        self._measure([b for b in begins if b not in self.pairs])
        cheap = [b for b in begins if self.pairs[b] <= PAIRS_PER_ROW]
        covered = {b: sum(set(b) <= set(c) for c in combos) for b in cheap}
        best = max(cheap, key=lambda b: (covered[b], -len(b), -self.pairs[b]), default=None)
        return best if best is not None and covered[best] > 1 else None

    def _measure(self, combos: list[Combo]) -> None:
        """Estimate pairs, those of keys that count as compared, from the pairs in a sample that is written once."""
        if not combos:
            return
        table, n_rows = self.table, self.table.n_rows
        wanted = max(MEASURED_FLOOR, MEASURED_PER_ROOT * isqrt(n_rows))
        share = min(1.0, wanted / n_rows)
        if self.drawn is None:
            self.drawn = table.frame
            if share < 1:
                parts = max(1, min(table.spark.sparkContext.defaultParallelism, wanted // 2_000))
                self.drawn = durable(table.frame.sample(share, seed=57).repartition(parts))
        cells = G.cells(self.drawn, table.layout(combos), self.skip_nulls)
        # Both rows of a pair are in the sample with the square of the share.
        compared = F.least(F.col("size") * (F.col("size") - 1) / share**2, F.col("size") * MOST_ROWS / share) / 2
        with roomy(table.spark, min(wanted, n_rows) * len(combos)):
            sums = G.sizes(cells).groupBy("combo").agg((F.sum(compared) / F.sum(F.col("size") / share)).alias("pairs"))
            seen = {r["combo"]: r["pairs"] for r in sums.collect()}
        self.pairs |= {c: seen.get(i, float("inf")) for i, c in enumerate(combos)}

    def run(self, combo: Combo, wanted: Sequence[int] | None = None) -> Pivot:
        """Compare all rows that share a key; with `wanted`, agree sets that hold none of these are left out."""
        table = self.table
        slots = sorted({s for own in table.slots for s in own})
        keys = [f"s{s}" for s in table.layout([combo])[0]]
        rows = table.frame.select(*[f"s{s}" for s in slots])
        if self.skip_nulls:
            rows = rows.dropna(subset=keys)
        rest, few = None, rows
        with roomy(table.spark, table.n_rows):
            frequent = table.dealt(table.n_rows).select(*[F.col(k).alias(f"r_{k}") for k in keys])
            frequent = durable(frequent.groupBy(*frequent.columns).count().where(F.col("count") > MOST_ROWS))
            size = frequent.agg(F.count(F.lit(1)).alias("keys"), F.sum("count").alias("rows")).first()
        n_cells = table.n_rows * len(slots)
        with roomy(table.spark, n_cells):
            if size["keys"]:
                side = F.broadcast(frequent) if size["keys"] <= BROADCAST_ROWS else frequent
                same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
                left = durable(rows.join(side, same, "left_semi"))
                n_left, largest = rows_and_largest(left)
                rest = replace(table, stored=left, n_rows=n_left, largest=largest) if n_left else None
                few = rows.join(side, same, "left_anti")
            tasks = max(table.spark.sparkContext.defaultParallelism, -(-n_cells // CELLS_PER_PARTITION))
            place = {s: i for i, s in enumerate(slots)}
            compare = _comparison(
                [place[s] for s in table.layout([combo])[0]], [[place[s] for s in own] for own in table.slots], self.skip_nulls, wanted
            )
            # All rows of a key are in one slice; a slice's rows are on disk only while they are compared.
            slices, said = -(-n_cells // (CODES_PER_CELL * most_cells(table.n_rows))), []
            for i in range(slices):
                own = few.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == i) if slices > 1 else few
                dealt = own.repartition(-(-tasks // slices), *keys).sortWithinPartitions(*keys)
                said += dealt.mapInArrow(compare, "mask string, complete boolean").distinct().collect()
        masks = {int(r["mask"], 16) for r in said if r["mask"]}
        pivot = Pivot(combo, masks, wanted is None and all(r["complete"] for r in said), rest)
        self.found.append(pivot)
        self.masks |= masks
        return pivot


def _comparison(keys: list[int], columns: list[list[int]], skip_nulls: bool, wanted: Sequence[int] | None):
    """Compare the rows of each key, in batches sorted by it: (mask as hex, whether no set was left out)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        complete, room, tail = True, MOST_SETS, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            n_old = 0
            if tail is not None:
                n_old, rows = tail.num_rows, pa.concat_tables([tail, rows])
            values, empty = _arrays(rows)
            differs = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
            for k in keys:
                differs |= ~_equal(values[k], empty[k], slice(1, None), slice(None, -1), False)
            group = np.concatenate(([0], np.cumsum(differs)))
            for words in _pairs(group, n_old, values, empty, columns, skip_nulls):
                for mask in words:
                    if mask not in seen and (wanted is None or any(t & ~mask == 0 for t in wanted)):
                        seen.add(mask)
            if len(seen) > room:
                seen, complete = set(maximal(seen)), False
                room = max(room, 2 * len(seen))
            tail = rows.slice(int(np.searchsorted(group, group[-1])))
        out = [f"{m:x}" for m in seen]
        yield pa.RecordBatch.from_pydict(
            {"mask": pa.array([*out, None], pa.string()), "complete": pa.array([complete] * (len(out) + 1), pa.bool_())}
        )

    return compare


def _arrays(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Values of each column, and where it is null if it is anywhere."""
    empty = [c.is_null().to_numpy() if c.null_count else None for c in rows.columns]
    return [(c.fill_null(0) if c.null_count else c).to_numpy() for c in rows.columns], empty


def _equal(values, empty, x, y, skip_nulls: bool) -> np.ndarray:
    same = values[x] == values[y]
    if empty is None:
        return same
    return same & ~empty[x] & ~empty[y] if skip_nulls else same & (empty[x] == empty[y])


def _pairs(group, n_old: int, values, empty, columns, skip_nulls: bool) -> Iterator[list[int]]:
    """Masks of the pairs of rows of a group, by their distance; both rows of a pair among the old ones were compared before."""
    later = np.arange(max(n_old, 1), len(group))
    for far in range(1, len(group)):
        later = later[later >= far]
        later = later[group[later] == group[later - far]]
        if not len(later):
            return
        words = []
        for first in range(0, len(columns), WORD):
            word = np.zeros(len(later), dtype=np.int64)
            for i, own in enumerate(columns[first : first + WORD]):
                same = reduce(np.logical_and, [_equal(values[p], empty[p], later, later - far, skip_nulls) for p in own])
                word |= same.astype(np.int64) << i
            words.append(word)
        if len(words) == 1:
            yield pd.unique(words[0]).tolist()
        else:
            told = pd.DataFrame(dict(enumerate(words))).drop_duplicates().itertuples(index=False)
            yield [sum(int(w) << WORD * k for k, w in enumerate(row)) for row in told]
