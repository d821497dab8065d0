"""Group sizes of many column combinations in one job.

Every row is turned into one narrow cell per combination: the combination's number
and the codes of its columns. One hash aggregate then counts all combinations at
once; Spark combines on the map side, so a value that fills a third of the table
reaches the shuffle once per task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Combo = tuple[int, ...]


@dataclass(frozen=True)
class Counts:
    """What the group sizes of one combination say, over the rows it looks at."""

    rows: int
    groups: int
    largest: int
    repeated_groups: int
    repeated_rows: int

    @property
    def excess(self) -> int:
        """Rows that would have to go to make the combination unique."""
        return self.rows - self.groups

    @property
    def is_unique(self) -> bool:
        return self.largest <= 1


NOTHING = Counts(0, 0, 0, 0, 0)


def key_names(depth: int) -> list[str]:
    return [f"k{j}" for j in range(depth)]


def depth_of(layout: Sequence[Sequence[int]]) -> int:
    return max(len(slots) for slots in layout)


def plan_of(layout, position: dict[int, int], numbers: Iterable[int], owners=None, depth: int | None = None) -> Column:
    """A constant array with one entry per combination: its number and where its keys are."""
    depth = depth_of(layout) if depth is None else depth
    entries = []
    for i, number in enumerate(numbers):
        entry = {"combo": number} if owners is None else {"combo": number, "owner": owners[i]}
        entry |= {f"p{j}": position[slot] for j, slot in enumerate(layout[i]) if slot is not None}
        entries.append(entry)
    fields = ["combo int"] + (["owner int"] if owners is not None else []) + [f"p{j} int" for j in range(depth)]
    return F.from_json(F.lit(json.dumps(entries)), f"array<struct<{','.join(f.replace(' ', ':') for f in fields)}>>")


def keys_at(codes: Column, entry: str, depth: int) -> list[Column]:
    return [F.get(codes, F.col(f"{entry}.p{j}")).alias(f"k{j}") for j in range(depth)]


def complete(entry: str, depth: int) -> Column:
    """No key of the combination is null; slots the combination does not use are skipped."""
    ok = F.lit(True)
    for j in range(depth):
        ok = ok & (F.col(f"{entry}.p{j}").isNull() | F.col(f"k{j}").isNotNull())
    return ok


def cells(
    rows: DataFrame, layout: Sequence[Sequence[int | None]], skip_nulls: bool, numbers=None, depth: int | None = None
) -> DataFrame:
    """(combo, k0, k1, ...): one cell per row and combination; `layout` lists code columns s<i>.

    Combinations are numbered from 0, or by `numbers`; there are `depth` keys, or as many as needed.
    """
    depth = depth_of(layout) if depth is None else depth
    if len(layout) == 1:  # the row is the cell
        own = [F.lit(None).cast("long") if slot is None else F.col(f"s{slot}") for slot in layout[0]]
        own += [F.lit(None).cast("long")] * (depth - len(own))
        if skip_nulls:
            rows = rows.dropna(subset=[f"s{slot}" for slot in layout[0] if slot is not None])
        number = list(numbers)[0] if numbers else 0
        return rows.select(F.lit(number).alias("combo"), *[c.alias(k) for c, k in zip(own, key_names(depth))])
    used = sorted({slot for slots in layout for slot in slots if slot is not None})
    plan = plan_of(layout, {slot: i for i, slot in enumerate(used)}, numbers or range(len(layout)), depth=depth)
    exploded = rows.select(F.array(*[F.col(f"s{slot}") for slot in used]).alias("codes")).select(
        "codes", F.explode(plan).alias("entry")
    )
    keyed = exploded.select(F.col("entry"), *keys_at(F.col("codes"), "entry", depth))
    if skip_nulls:
        keyed = keyed.where(complete("entry", depth))
    return keyed.select(F.col("entry.combo").alias("combo"), *key_names(depth))


def sizes(cell_frame: DataFrame) -> DataFrame:
    """(combo, keys, size): how many rows share each key."""
    keys = [c for c in cell_frame.columns if c != "combo"]
    return cell_frame.groupBy("combo", *keys).agg(F.count(F.lit(1)).alias("size"))


def summary(size_frame: DataFrame) -> DataFrame:
    repeated = F.col("size") > 1
    return size_frame.groupBy("combo").agg(
        F.sum("size").alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.max("size").alias("largest"),
        F.count_if(repeated).alias("repeated_groups"),
        F.sum(F.when(repeated, F.col("size")).otherwise(0)).alias("repeated_rows"),
    )


def read_counts(summary_frame: DataFrame, n: int) -> list[Counts]:
    """Bring one line per combination to the driver, in the order of the layout."""
    found = {
        r["combo"]: Counts(r["rows"], r["groups"], r["largest"], r["repeated_groups"], r["repeated_rows"])
        for r in summary_frame.collect()
    }
    return [found.get(i, NOTHING) for i in range(n)]
