"""A table as columns of 64-bit codes that are proven to stand for its values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solekey.functions.combos import column
from solekey.functions import codes as C
from solekey.plans import groups as G
from solekey.plans.groups import Combo, Counts
from solekey.session import CELLS_PER_PARTITION, even_parts, filled, is_small, is_uneven, most_cells, roomy, rows_and_largest, spread

NULLS = ("equal", "distinct")
MAX_SLOTS = 4

# A side of at most this many narrow rows (tens of megabytes) may be broadcast.
BROADCAST_ROWS = 500_000


def check_nulls(nulls: str) -> bool:
    """True when rows with a null in the combination are left out."""
    if nulls not in NULLS:
        raise ValueError(f"nulls must be one of {NULLS}, not {nulls!r}")
    return nulls == "distinct"


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame whose row count was measured and is small; leave others to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class CodedTable:
    """`frame` has bigint columns s0, s1, ...; `slots[i]` are the ones that code column i."""

    source: DataFrame
    names: list[str]
    exprs: list[Column]
    slots: list[tuple[int, ...]]
    wide: list[bool]
    n_rows: int
    single: list[Counts] = field(default_factory=list)  # nulls left out
    nulls: list[int] = field(default_factory=list)
    stored: DataFrame | None = None
    source_largest: int = 0  # rows of the largest partition of the source
    largest: int = 0  # and of the frame

    @property
    def uneven(self) -> bool:
        return is_uneven(self.spark, self.n_rows, self.source_largest)

    @property
    def frame(self) -> DataFrame:
        if self.stored is not None:
            return self.stored
        return spread(self.source.select(*self.exprs), self.n_rows)

    def dealt(self, n_cells: int) -> DataFrame:
        """The codes in so many parts that a task has room for all cells it makes of its rows.

        What a task combines before a shuffle it holds in memory, and files with large row
        groups give a few tasks all rows.
        """
        if self.largest * n_cells <= CELLS_PER_PARTITION * self.n_rows:
            return self.frame
        return self.frame.repartition(max(-(-n_cells // CELLS_PER_PARTITION), self.spark.sparkContext.defaultParallelism))

    @property
    def spark(self):
        return self.source.sparkSession

    def layout(self, combos: Sequence[Combo]) -> list[tuple[int, ...]]:
        return [tuple(s for col in combo for s in self.slots[col]) for combo in combos]

    def counts(self, combos: Sequence[Combo], skip_nulls: bool, rows: DataFrame | None = None, n_rows=None):
        """Exact group statistics of every combination; one read of the codes for all whose cells may be on disk together."""
        found, n_rows = {}, self.n_rows if n_rows is None else n_rows
        each = max(1, most_cells(self.n_rows) // max(1, n_rows))
        for first in range(0, len(combos), each):
            batch = list(combos)[first : first + each]
            frame = self.dealt(self.n_rows * len(batch)) if rows is None else rows
            with roomy(self.spark, len(batch) * n_rows):
                sized = G.sizes(G.cells(frame, self.layout(batch), skip_nulls))
                found |= zip(batch, G.read_counts(G.summary(sized), len(batch)))
        return found

    def column_counts(self, col: int, skip_nulls: bool) -> Counts:
        """Statistics of a single column under the null rule, from the counts already made."""
        seen, empty = self.single[col], self.nulls[col]
        if skip_nulls or not empty:
            return seen
        again = 1 if empty > 1 else 0
        return Counts(
            seen.rows + empty,
            seen.groups + 1,
            max(seen.largest, empty),
            seen.repeated_groups + again,
            seen.repeated_rows + (empty if again else 0),
        )

    def profile(self) -> list[tuple[int, int]]:
        """(nulls, about how many different values) of every column, by sketches that tasks merge."""
        codes = [F.xxhash64(*[f"s{s}" for s in slots]) if len(slots) > 1 else F.col(f"s{slots[0]}") for slots in self.slots]
        firsts = [F.count(f"s{slots[0]}").alias(f"c{i}") for i, slots in enumerate(self.slots)]
        row = self.frame.agg(*firsts, *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(codes)]).first()
        return [(self.n_rows - row[f"c{i}"], row[f"d{i}"]) for i in range(len(self.slots))]

    def reorder(self, order: Sequence[int]) -> None:
        """Number the columns anew: column i is the one that was number order[i]."""
        for name in ("names", "slots", "wide", "single", "nulls"):
            old = getattr(self, name)
            setattr(self, name, [old[i] for i in order])

    def keep(self, cols: Sequence[int]) -> None:
        """Store only the code columns of `cols`, for use by several passes.

        Codes that a few tasks read for all are dealt out, by all codes at once: no task has to sort its rows.
        """
        wanted = [f"s{s}" for s in sorted({s for col in cols for s in self.slots[col]})]
        codes = self.frame.select(*wanted)
        if not self.uneven:
            self.stored = codes.persist(StorageLevel.MEMORY_AND_DISK)
            return
        parts = even_parts(self.spark, self.n_rows)
        self.stored, self.largest = codes.repartition(parts, *wanted).persist(StorageLevel.MEMORY_AND_DISK), -(-self.n_rows // parts)
        filled(self.stored)

    def release(self) -> None:
        if self.stored is not None:
            self.stored.unpersist()
            self.stored, self.largest = None, self.source_largest


def code_table(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    hasher: Callable[[Column, int], Column] = C.hashed,
    reuse: bool = False,
    stats: bool = True,
    prove: bool = True,
) -> CodedTable:
    """Code the columns of a table and prove that the codes are one-to-one.

    The same jobs give the exact group statistics of every single column; without
    `stats` only the columns that need a proof are counted. With `reuse` the codes of a
    table too small to fill the cluster, or read by a few tasks, are stored from the start. Without `prove` the
    codes only tell which rows cannot have an equal value.
    """
    names = list(df.columns if cols is None else cols)
    schema = {f.name: f.dataType for f in df.schema.fields}
    for name in names:
        C.check_groupable(name, schema[name])
    wide = [C.needs_proof(schema[name]) for name in names]
    values = [column(name) for name in names]
    exprs = [
        (hasher(value, 0) if wide[i] else C.code(value, schema[name])).alias(f"s{i}")
        for i, (name, value) in enumerate(zip(names, values))
    ]
    n_rows, largest = rows_and_largest(df)
    if is_small(df.sparkSession, n_rows):
        largest = min(largest, -(-n_rows // df.sparkSession.sparkContext.defaultParallelism))  # as spread() deals them
    table = CodedTable(
        source=df.select(*values),
        names=names,
        exprs=exprs,
        slots=[(i,) for i in range(len(names))],
        wide=wide,
        n_rows=n_rows,
        single=[G.NOTHING] * len(names),
        nulls=[0] * len(names),
        source_largest=largest,
        largest=largest,
    )
    if reuse and (table.uneven or is_small(df.sparkSession, n_rows)):
        table.keep(range(len(names)))
    pending = [c for c in range(len(names)) if stats or wide[c]]
    for slot in range(1, MAX_SLOTS + 1):
        counted = table.counts([(c,) for c in pending], skip_nulls=True) if pending else {}
        for c in pending:
            table.single[c] = counted[(c,)]
            table.nulls[c] = table.n_rows - counted[(c,)].rows
        pending = _collided(table, [c for c in pending if wide[c]]) if prove else []
        if not pending:
            return table
        for c in pending:
            table.release()
            table.slots[c] = (*table.slots[c], len(table.exprs))
            table.exprs.append(hasher(values[c], slot).alias(f"s{len(table.exprs)}"))
    raise RuntimeError(f"no one-to-one code found for columns {[names[c] for c in pending]}")


def _collided(table: CodedTable, cols: Sequence[int]) -> list[int]:
    """The columns where two different values share a code.

    A column whose codes are all different needs no look at its values. Where few
    rows share a code only those rows are compared; otherwise values are grouped
    once, which the map side shrinks whenever they repeat.
    """
    failed = []
    whole: dict[str, list[int]] = {}
    for c in cols:
        stat = table.single[c]
        if stat.is_unique:
            continue
        if few_repeats(table, c):
            if _values_in_repeated_codes(table, c) != stat.repeated_groups:
                failed.append(c)
        else:
            whole.setdefault(table.source.schema[table.names[c]].dataType.simpleString(), []).append(c)
    for same_type in whole.values():
        pairs = F.array(
            *[F.struct(F.lit(c).alias("col"), column(table.names[c]).alias("value")) for c in same_type]
        )
        n_cells, source = table.n_rows * len(same_type), table.source
        if table.uneven:
            source = source.select(*[column(table.names[c]) for c in same_type]).repartition(even_parts(table.spark, n_cells))
        distinct = (
            source.select(F.explode(pairs).alias("p"))
            .select("p.*")
            .where(F.col("value").isNotNull())
            .distinct()
            .groupBy("col")
            .count()
        )
        with roomy(table.spark, n_cells):
            found = {r["col"]: r["count"] for r in distinct.collect()}
        failed += [c for c in same_type if found.get(c, 0) != table.single[c].groups]
    return sorted(failed)


def _values_in_repeated_codes(table: CodedTable, col: int) -> int:
    keys = [f"s{s}" for s in table.slots[col]]
    return rows_with_repeated_codes(table, col).select(*keys, "value").distinct().count()


def few_repeats(table: CodedTable, col: int) -> bool:
    """Few rows share a code, and the codes they share can be broadcast."""
    stat = table.single[col]
    return stat.repeated_rows * 4 <= table.n_rows and stat.repeated_groups <= BROADCAST_ROWS


def rows_with_repeated_codes(table: CodedTable, col: int) -> DataFrame:
    """(s..., value): the rows of a column whose code occurs more than once, nulls left out."""
    keys = [f"s{s}" for s in table.slots[col]]
    value = column(table.names[col])
    coded = table.source.select(*[table.exprs[s] for s in table.slots[col]], value.alias("value"))
    coded = coded.where(F.col("value").isNotNull())
    codes = table.dealt(table.n_rows).select(*keys).where(F.col(keys[0]).isNotNull())
    repeated = codes.groupBy(*keys).count().where(F.col("count") > 1).drop("count")
    return coded.join(small_side(repeated, table.single[col].repeated_groups), keys, "left_semi")
