"""Minimal unique combinations from the other side: through sets of columns that rows agree on.

Two rows that agree on a set of columns prove that it, and all its subsets, repeat. So a
unique combination needs, for every such pair, a column on which the rows differ: unique
combinations are the sets that hit the complements of all agree sets, and the minimal ones
the minimal hitting sets. The search keeps the agree sets met so far and the minimal sets
that hit them all, and asks the table which of these repeat. Each one that does has rows
that agree on more than was known; when none does, all are found. The first agree sets
come from a sample. Sets that have a part with few rows to each key are answered together
by the agree sets of all rows that share a key of that part (plans.pivots); the others take a
few waves over the table, for all sets at once.

A level-wise search passes through every combination that repeats; this one only meets the
edge between those that repeat and those that don't, which suits wide tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solekey.plans import groups as G
from solekey.plans import waves
from solekey.plans.coded import CodedTable
from solekey.plans.groups import Combo
from solekey.plans.pivots import Pivots, mask_of, maximal
from solekey.session import discard

# Repeated keys of each combination whose rows are looked at, and pairs of rows of each key.
KEYS_PER_SET = 8


def columns_of(mask: int) -> Combo:
    return tuple(i for i in range(mask.bit_length()) if mask >> i & 1)


def hit(transversals: Sequence[int], edge: int, max_size: int | None = None) -> list[int]:
    """The minimal sets that hit all edges so far and `edge` too, from those that hit all edges so far."""
    good = [t for t in transversals if t & edge]
    made = []
    for t in transversals:
        if t & edge or (max_size is not None and t.bit_count() >= max_size):
            continue
        for c in columns_of(edge):
            wider = t | 1 << c
            # Another set of the old ones that lies in it must hold c, as they don't hold one another.
            if not any(g & ~wider == 0 for g in good):
                made.append(wider)
    return good + made


def minimal_hitting_sets(agreeing: Iterable[int], width: int, max_size: int | None = None) -> list[int]:
    """The minimal sets of columns that are in none of the given sets."""
    every = (1 << width) - 1
    found = [0]
    for mask in sorted(maximal(agreeing), key=lambda m: -m.bit_count()):
        found = hit(found, every & ~mask, max_size)
    return found


def find_dual(table: CodedTable, sample: DataFrame | None, sample_rows: int, skip_nulls: bool, max_arity, max_sets) -> list[Combo]:
    """The minimal unique combinations of a table of at least two rows, as ordinals."""
    width = len(table.names)
    agreeing: set[int] = set()
    stages = [table]
    if sample is not None:
        stages.insert(0, replace(table, stored=sample, n_rows=sample_rows, largest=sample_rows))
    unique: list[Combo] = []
    for part in stages:
        pivots = Pivots(part, skip_nulls) if part is table else None
        proven: set[int] = set()  # unique in this part
        while True:
            wanted = minimal_hitting_sets(agreeing, width, max_arity)
            if max_sets is not None and len(wanted) > max_sets:
                raise RuntimeError(f"more than {max_sets} candidates; set max_arity or pass fewer columns")
            open_sets = [t for t in wanted if t not in proven]
            if not open_sets:
                break
            if pivots is not None:
                lone = [c for c in map(columns_of, open_sets) if pivots.of(c) is None]
                if lone and (chosen := pivots.choose(lone)):
                    agreeing = set(maximal(agreeing | pivots.run(chosen, wanted).masks))
                    continue
            repeating, more = set(), set()
            for rows, combos in _asked(part, pivots, open_sets):
                repeated, agree = _evidence(rows, combos, skip_nulls)
                repeating |= repeated
                more |= agree
            proven |= {t for t in open_sets if t not in repeating}
            if not repeating:
                break
            if not all(any(t & ~m == 0 for m in more) for t in repeating):
                raise RuntimeError("a repeated combination without rows that agree on it")
            agreeing = set(maximal(agreeing | more))
        unique = [columns_of(t) for t in wanted]
    return sorted(unique, key=lambda c: (len(c), c))


def _asked(part: CodedTable, pivots: Pivots | None, open_sets: list[int]) -> list[tuple[CodedTable, list[Combo]]]:
    """The combinations that agree sets leave open, with the rows that decide them."""
    asked: dict[int, tuple[CodedTable, list[Combo]]] = {}
    for c in map(columns_of, open_sets):
        pivot = pivots.of(c) if pivots is not None else None
        if pivot is None or pivot.rest is not None:
            rows = part if pivot is None else pivot.rest
            asked.setdefault(id(rows), (rows, []))[1].append(c)
    return list(asked.values())


def _evidence(table: CodedTable, combos: list[Combo], skip_nulls: bool) -> tuple[set[int], set[int]]:
    """Which combinations repeat, and the columns that some of their repeated rows agree on."""
    if combos == [()]:
        more = _agree_sets(table, combos, None, skip_nulls)
        return ({0} if more else set()), more
    held: list[DataFrame] = []
    try:
        found = waves.repeats(table, combos, skip_nulls, lambda s: s.rows > 0, held)
        repeating = [c for c in combos if c in found.refuted or found.counts[c].rows]
        if not repeating:
            return set(), set()
        keys = reduce(DataFrame.unionByName, found.keys).drop("size")
        return {mask_of(c) for c in repeating}, _agree_sets(table, combos, keys, skip_nulls)
    finally:
        for frame in held:
            discard(frame)


def _agree_sets(table: CodedTable, combos: list[Combo], keys: DataFrame | None, skip_nulls: bool) -> set[int]:
    """Agree sets of the outermost rows of a few repeated keys of each combination, or of the whole table.

    Of a key's rows the first and the last by all codes, and by all codes backwards, are compared:
    aggregates that tasks combine, however many rows a key has.
    """
    slots = sorted({s for own in table.slots for s in own})
    frame = table.frame.select([f"s{s}" for s in slots])
    codes, back = F.struct(*frame.columns), F.struct(*reversed(frame.columns))
    if keys is None:
        rows, by = frame, []
    else:
        layout = table.layout(combos)
        names = G.key_names(G.depth_of(layout))
        plan = G.plan_of(layout, {s: i for i, s in enumerate(slots)}, range(len(combos)))
        cells = frame.select("*", F.array(*frame.columns).alias("codes"), F.explode(plan).alias("entry"))
        cells = cells.select(*frame.columns, F.col("entry.combo").alias("combo"), *G.keys_at(F.col("codes"), "entry", len(names)))
        few = _few_keys(keys, names)
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in ("combo", *names)])
        rows, by = cells.join(F.broadcast(few), same, "left_semi"), ["combo", *names]
    ends = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(codes).alias("a"),
        F.max(codes).alias("b"),
        F.min_by(codes, back).alias("c"),
        F.max_by(codes, back).alias("d"),
    )
    pairs = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "cd", "ac", "bd", "ad", "bc")])
    # Equal ends are two rows only where all rows of the key are equal.
    compared = ends.where("n > 1").select((F.col("a").eqNullSafe(F.col("b"))).alias("alike"), F.explode(pairs).alias("p"))
    compared = compared.where("alike OR NOT p.x <=> p.y")
    agree = []
    for own in table.slots:
        equal = [(F.col(f"p.x.s{s}"), F.col(f"p.y.s{s}")) for s in own]
        equal = [F.coalesce(x == y, F.lit(False)) if skip_nulls else x.eqNullSafe(y) for x, y in equal]
        agree.append(reduce(lambda x, y: x & y, equal))
    found = compared.select(F.array(*agree).alias("agree")).distinct().collect()
    return {mask_of(i for i, e in enumerate(r["agree"]) if e) for r in found}


def _few_keys(keys: DataFrame, names: list[str]) -> DataFrame:
    """At most KEYS_PER_SET repeated keys of each combination, under names of their own."""
    order = Window.partitionBy("combo").orderBy(F.xxhash64(*names), *names)
    few = keys.withColumn("place", F.row_number().over(order)).where(F.col("place") <= KEYS_PER_SET)
    return few.select(*[F.col(k).alias(f"r_{k}") for k in ("combo", *names)])
