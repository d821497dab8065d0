"""All minimal unique column combinations of a table, level by level.

A level's candidates are first grouped on a sample whose size grows with the square
root of the table. A repeated key in the sample is a repeated key of the table, and
two sample rows that agree on C without b but not on b prove that b is not determined
by the rest of C. Candidates with both proofs need no pass over the table. Only the
others are counted in full: those without a repeat in the sample (they may be unique)
and those that look as if one column followed from the rest.

If b does follow from the rest of C on the whole table, dropping b from any unique
superset of C leaves it unique, so no minimal combination contains C and the search
drops it. Constant and equivalent columns are special cases.

Counting in full leaves behind the keys that repeat. A superset can only repeat within
those rows, so it is checked on them alone; the pools shrink from level to level.

Combinations that share a part with few rows to each key are settled together: all rows that
share a key of it are compared (plans.pivots), and so are dependencies on it. What else
a level has to ask of the whole table it asks in a few waves, each of which reads the
codes once for all its combinations (plans.waves). Columns are numbered by how many different
values they have, most first, so that combinations with a prefix in common are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.operators.frames import combination_frame
from solekey.operators.lattice import describe, next_candidates
from solekey.plans import groups as G
from solekey.plans import waves
from solekey.plans.bounds import cover_bound
from solekey.plans.coded import BROADCAST_ROWS, CodedTable, check_nulls, code_table, small_side
from solekey.plans.dual import find_dual
from solekey.plans.groups import Combo, Counts
from solekey.plans.pivots import Pivots
from solekey.plans.state import SearchState
from solekey.session import discard, durable, fine_reads, most_cells, roomy, temporary, tidy

SAMPLE_FLOOR = 20_000
SAMPLE_PER_ROOT = 64

# A coherent sample of a column is used if it has at most so many times the rows of the uniform one.
COHERENT_EXCESS = 4

# Columns with about so many values at most are counted exactly, for bounds.
FEW_VALUES = 1_000

# Columns with more different values than this are not cheap to read and hash again.
MANY_VALUES = 100_000

# A pool of repeated rows is used when it is at most this part of the table, while all pools
# of a level together have at most that part of its rows.
POOL_SHARE = 32
POOLS_SHARE = 8


# Up to so many combinations, which the driver holds anyway, are joined there; a job would take longer.
LOCAL_SETS = 2_000

METHODS = ("levels", "dual")


def sample_target(n_rows: int) -> int:
    return max(SAMPLE_FLOOR, SAMPLE_PER_ROOT * isqrt(n_rows))


@dataclass
class Pool:
    """Rows that repeat under some combinations: (owner int, codes array<bigint>)."""

    rows: DataFrame | None
    owners: dict[Combo, int]
    n_rows: dict[Combo, int]


@dataclass
class Level:
    """What is known about the combinations of one size that stay in the search."""

    in_sample: dict[Combo, int | None]  # excess in the sample, if it was asked
    in_full: dict[Combo, int] = field(default_factory=dict)  # excess in the table, where counted
    pool: Pool | None = None


def minimal_uccs(
    df: DataFrame,
    max_arity: int | None = None,
    nulls: str = "equal",
    max_candidates: int | None = None,
    sample_rows: int | None = None,
    method: str = "levels",
    resume: str | None = None,
) -> DataFrame:
    """All minimal unique column combinations: (ucc, columns, arity).

    max_arity ends the search at combinations of that size. With max_candidates, a level
    of more combinations raises an error; nothing is ever left out silently. sample_rows
    sets the size of the first sample: it changes the plan, never the answer. So does method:
    "levels" goes up level by level, "dual" through the sets of columns that rows agree on,
    which suits wide tables. With the name resume, a search by levels keeps what it knows in
    the shared folder after every level; called again under that name, also by another
    driver, it goes on from there. The state is deleted when the search ends.
    """
    found, names = find(df, max_arity, nulls, max_candidates, sample_rows, method, resume)
    return describe(combination_frame(df.sparkSession, sorted(found, key=lambda c: (len(c), c))), names)


def find(df, max_arity=None, nulls="equal", max_candidates=None, sample_rows=None, method="levels", resume=None):
    """The combinations as ordinals, and the column names. Frames written on the way are deleted."""
    skip_nulls = check_nulls(nulls)
    if max_arity is not None and max_arity < 1:
        raise ValueError("max_arity must be at least 1")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if resume is not None and method != "levels":
        raise ValueError("only a search by levels can be resumed")
    with temporary(df.sparkSession), tidy(df.sparkSession), fine_reads(df):
        table = code_table(df, reuse=True, stats=False)
        names, order, search = table.names, list(range(len(table.names))), None
        try:
            profile = table.profile() if table.n_rows > 1 else []
            order.sort(key=lambda c: -profile[c][1] if profile else 0)
            table.reorder(order)
            profile = [profile[c] for c in order] if profile else []
            search = _Search(table, skip_nulls, max_candidates, sample_rows, profile)
            if resume is not None:
                about = {"columns": df.dtypes, "rows": table.n_rows, "nulls": nulls, "max_arity": max_arity, "order": order}
                search.state = SearchState(df.sparkSession, resume, about)
            found = search.run_dual(max_arity) if method == "dual" else search.run(max_arity)
        finally:
            if search:
                search.release()
            table.release()
    return [tuple(sorted(order[c] for c in combo)) for combo in found], names


class _Search:
    def __init__(self, table: CodedTable, skip_nulls: bool, max_candidates: int | None, sample_rows, profile):
        self.table = table
        self.spark = table.spark
        self.max_candidates = max_candidates
        self.sample_rows = sample_target(table.n_rows) if sample_rows is None else sample_rows
        self.sampled: DataFrame | None = None
        self.sample_is_table = False
        self.nulls = [empty for empty, _ in profile] if skip_nulls else [0] * len(table.names)
        self.skip_nulls = skip_nulls and any(self.nulls)  # a table without any follows the simpler rule
        self.profile = profile
        self.known: dict[Combo, Counts] = {}  # full counts of single columns
        self.bounds: dict[Combo, int] = {}  # no combination has more different keys
        self.slots: list[int] = []
        self.held: list[DataFrame] = []
        self.coherent: Pool | None = None
        self.settled = 0  # by bounds alone
        self.pivots = Pivots(table, self.skip_nulls)
        self.state: SearchState | None = None

    def run(self, max_arity: int | None) -> list[Combo]:
        table = self.table
        singles = [(c,) for c in range(len(table.names))]
        if table.n_rows <= 1 or not singles:
            return singles
        if self._worth_storing():
            table.keep(range(len(singles)))
        if self.state and (kept := self.state.read()):
            size, uccs, level = self._remembered(*kept)
        else:
            size, uccs, level = self._first_level(singles, max_arity)
        while level.in_sample and (max_arity is None or size < max_arity):
            candidates = self._candidates(level)
            size += 1
            if not candidates:
                break
            found, above = self._check(candidates, level, last=size == max_arity)
            if level.pool:
                discard(level.pool.rows)
            uccs, level = uccs + found, above
            self._remember(size, uccs, level)
        if self.state:
            self.state.clear()
        return uccs

    def run_dual(self, max_arity: int | None) -> list[Combo]:
        table = self.table
        if table.n_rows <= 1 or not table.names:
            return [(c,) for c in range(len(table.names))]
        if self._worth_storing():
            table.keep(range(len(table.names)))
        self._take_sample()
        sample = None if self.sample_is_table else self.sampled
        return find_dual(table, sample, self.sample_rows, self.skip_nulls, max_arity, self.max_candidates)

    def _first_level(self, singles: list[Combo], max_arity: int | None) -> tuple[int, list[Combo], Level]:
        """Single columns: the size 1, the unique ones, and what is known of the others."""
        table = self.table
        self._take_sample()
        in_sample = self._sample_counts(singles)
        self.known = in_sample if self.sample_is_table else self._count_columns(in_sample)
        self._count_few_values()
        uccs = [c for c in singles if c in self.known and self.known[c].is_unique]
        rest = [c for c in singles if c not in uccs and not self._decides_nothing(c)]
        if len(rest) < 2 or max_arity == 1:
            return 1, uccs, Level({})
        self.slots = sorted({s for (c,) in rest for s in table.slots[c]})
        if self._rows_repeat(tuple(c for (c,) in rest)):
            return 1, uccs, Level({})
        level = Level(
            {c: in_sample[c].excess for c in rest}, {c: self.known[c].excess for c in rest if c in self.known}
        )
        self._remember(1, uccs, level)
        return 1, uccs, level

    # -- state kept for another driver -------------------------------------------

    def _remember(self, size: int, uccs: list[Combo], level: Level) -> None:
        if not self.state or not level.in_sample:
            return
        pairs = lambda found: [[list(c), n] for c, n in found.items()]
        facts = {
            "size": size,
            "uccs": [list(c) for c in uccs],
            "slots": self.slots,
            "in_sample": pairs(level.in_sample),
            "in_full": pairs(level.in_full),
            "bounds": pairs(self.bounds),
            "sample_is_table": self.sample_is_table,
        }
        frames = {} if self.sample_is_table else {"sample": self.sampled}
        if level.pool:
            facts |= {"owners": pairs(level.pool.owners), "n_rows": pairs(level.pool.n_rows)}
            frames["pool"] = level.pool.rows
        self.state.write(size, facts, frames)

    def _remembered(self, facts: dict, frames: dict[str, DataFrame]) -> tuple[int, list[Combo], Level]:
        known = lambda pairs: {tuple(c): n for c, n in pairs}
        self.slots, self.bounds = facts["slots"], known(facts["bounds"])
        self.sample_is_table = facts["sample_is_table"]
        self.sampled = self.table.frame if self.sample_is_table else durable(frames["sample"])
        pool = None
        if "pool" in frames:
            # Copied, as the level's folder goes when the next level is finished.
            pool = Pool(durable(frames["pool"]), known(facts["owners"]), known(facts["n_rows"]))
        level = Level(known(facts["in_sample"]), known(facts["in_full"]), pool)
        return facts["size"], [tuple(c) for c in facts["uccs"]], level

    # -- single columns ----------------------------------------------------------

    def _count_few_values(self) -> None:
        """Exact numbers of values, for bounds: of columns counted before, and of those with few values."""
        empty = [n if not self.skip_nulls else 0 for n, _ in self.profile]
        self.bounds = {c: s.groups for c, s in self.known.items()}
        few = [c for c, (_, n) in enumerate(self.profile) if n <= FEW_VALUES and (c,) not in self.bounds]
        if few:
            values = [F.struct(*[f"s{s}" for s in self.table.slots[c]]) for c in few]
            present = [F.when(F.col(f"s{self.table.slots[c][0]}").isNotNull(), v) for c, v in zip(few, values)]
            sizes = [F.size(F.collect_set(v)).alias(str(c)) for c, v in zip(few, present)]
            row = self.table.frame.agg(*sizes).first()
            self.bounds |= {(c,): row[str(c)] + (1 if empty[c] else 0) for c in few}

    def _count_columns(self, in_sample: dict[Combo, Counts]) -> dict[Combo, Counts]:
        """Full counts of the columns that need them.

        Those with wide values were counted to prove their codes. Of the others, only
        columns that look unique or constant in the sample are counted.
        """
        wide = [c for c in in_sample if self.table.wide[c[0]]]
        known = {c: self.table.column_counts(c[0], self.skip_nulls) for c in wide}
        open_columns = [
            c for c, s in in_sample.items() if c not in known and (s.is_unique or s.groups == 1)
        ]
        if open_columns:
            known |= self.table.counts(open_columns, self.skip_nulls)
        return known

    def _decides_nothing(self, column: Combo) -> bool:
        """A constant column, unless its nulls take rows out of the check."""
        return column in self.known and self.known[column].groups <= 1 and self._always_counts(column[0])

    def release(self) -> None:
        """Give up everything stored on the way."""
        self._discard(len(self.held))

    def _discard(self, first: int) -> None:
        for frame in self.held[:first]:
            discard(frame)
        del self.held[:first]

    # -- candidates ------------------------------------------------------------

    def _candidates(self, level: Level) -> list[Combo]:
        kept = list(level.in_sample)
        if len(kept) <= LOCAL_SETS:
            found = _joined(kept)
        else:
            rows = next_candidates(combination_frame(self.spark, kept))
            if self.max_candidates is not None:
                rows = rows.limit(self.max_candidates + 1)
            found = sorted(tuple(r["cols"]) for r in rows.collect())
        if self.max_candidates is not None and len(found) > self.max_candidates:
            raise RuntimeError(
                f"more than {self.max_candidates} candidates of one size; "
                "set max_arity, raise max_candidates or pass fewer columns"
            )
        return found

    # -- evidence from the sample -----------------------------------------------

    def _worth_storing(self) -> bool:
        """Codes are kept if a column has many different wide values or few tasks read all rows, unless they are stored already.

        Otherwise a pass reads just its own columns from the source again, which costs less
        than a second copy of the table.
        """
        many = [s for s, wide in zip(self.table.single, self.table.wide) if wide and s.groups > MANY_VALUES]
        return self.table.stored is None and (self.table.uneven or bool(many))

    def _take_sample(self) -> None:
        n_rows = self.table.n_rows
        self.sample_is_table = n_rows <= self.sample_rows
        if self.sample_is_table:
            self.sampled = self.table.frame
            return
        parts = max(1, min(self.spark.sparkContext.defaultParallelism, self.sample_rows // 2_000))
        self.sampled = durable(self.table.frame.sample(self.sample_rows / n_rows, seed=17).repartition(parts))

    def _sample_counts(self, combos: Sequence[Combo]) -> dict[Combo, Counts]:
        n_rows = min(self.table.n_rows, self.sample_rows)
        return self.table.counts(combos, self.skip_nulls, self.sampled, n_rows)

    def _rows_repeat(self, every: Combo) -> bool:
        """Whole rows repeat: then nothing is unique and there is no lattice to walk."""
        if not self._sample_counts([every])[every].is_unique:
            return True
        if self.sample_is_table:
            return False
        keys = [f"s{slot}" for slot in self.slots]
        rows = self.table.dealt(self.table.n_rows).select(*keys)
        if self.skip_nulls:
            rows = rows.dropna()
        # Rows with different hashes are different; only equal hashes are looked at closely.
        hashed = rows.withColumn("h", F.xxhash64(*keys))
        repeated = durable(hashed.groupBy("h").count().where(F.col("count") > 1).select("h"))
        try:
            found = repeated.count()
            if not found:
                return False
            close = hashed.join(small_side(repeated, found), "h", "left_semi")
            return not close.groupBy(*keys).count().where(F.col("count") > 1).isEmpty()
        finally:
            discard(repeated)

    def _refute(self, combos: list[Combo]) -> list[Combo]:
        """On the last level: the combinations without a repeat in the coherent sample of their first column."""
        self._draw_coherent({c[0] for c in combos})
        pool = self.coherent
        drawn = [c for c in combos if (c[0],) in pool.owners]
        if not drawn:
            return combos
        position = {slot: i for i, slot in enumerate(self.slots)}
        owners = [pool.owners[(c[0],)] for c in drawn]
        with roomy(self.spark, sum(pool.n_rows[(c[0],)] for c in drawn)):
            cells = _pool_cells(pool.rows, self.table.layout(drawn), position, owners, self.skip_nulls)
            counts = G.read_counts(G.summary(G.sizes(cells).where(F.col("size") > 1)), len(drawn))
        refuted = {c for c, s in zip(drawn, counts) if s.rows}
        return [c for c in combos if c not in refuted]

    def _draw_coherent(self, columns: set[int]) -> None:
        """For each column a sample with all rows of every value in it, so that repeats stay together.

        Which values are drawn is up to their hash. A column whose draw has far more rows than
        wanted, because a drawn value is frequent, gets no sample.
        """
        share = self.sample_rows / self.table.n_rows
        drawn = {
            c: (F.shiftrightunsigned(F.xxhash64(F.lit(31), *[f"s{s}" for s in self.table.slots[c]]), 11) / float(2**53) < share)
            & (F.lit(True) if not self.skip_nulls else F.col(f"s{self.table.slots[c][0]}").isNotNull())
            for c in sorted(columns)
        }
        row = self.table.frame.agg(*[F.count_if(hit).alias(str(c)) for c, hit in drawn.items()]).first()
        usable = {c: n for c in drawn if 0 < (n := row[str(c)]) <= COHERENT_EXCESS * self.sample_rows}
        owners = {(c,): i for i, c in enumerate(usable)}
        which = F.array_compact(F.array(*[F.when(drawn[c], F.lit(i)) for (c,), i in owners.items()]))
        codes = F.array(*[F.col(f"s{slot}") for slot in self.slots]).alias("codes")
        rows = None
        if usable:
            rows = durable(self.table.frame.select(F.explode(which).alias("owner"), codes))
        self.coherent = Pool(rows, owners, {(c,): n for c, n in usable.items()})

    def _always_counts(self, col: int) -> bool:
        """Leaving the column out of a combination does not change which rows it looks at."""
        return not self.skip_nulls or not self.nulls[col]

    def _followers(self, combo: Combo, excess: int, before: dict[Combo, int]) -> list[Combo]:
        """Combinations with one column less and the same excess: that column adds nothing."""
        smaller = [(c, tuple(x for x in combo if x != c)) for c in combo if self._always_counts(c)]
        return [part for _, part in smaller if before.get(part) == excess]

    # -- one level ----------------------------------------------------------------

    def _check(self, candidates: list[Combo], before: Level, last: bool) -> tuple[list[Combo], Level]:
        known = {c for c in candidates if self._too_few_keys(c)}
        self.settled += len(known)
        compared = {c for c in candidates if self._compared(c)}
        asked = [c for c in candidates if c not in compared and not (last and c in known)]
        sampled = {c: s.excess for c, s in self._sample_counts(asked).items()}
        earlier = len(self.held)
        pool, dropped = None, set()
        if self.sample_is_table:
            full = sampled
        else:
            survivors = [c for c in candidates if (c in compared or sampled.get(c) == 0) and c not in known]
            survivors, settled = self._by_pivots(survivors, before)
            if last:
                pooled = [c for c in survivors if self._parent(c, before.pool) is not None]
                rest = [c for c in survivors if c not in pooled]
                survivors = pooled + (self._refute(rest) if rest else [])
            full, pool = self._count_survivors(survivors, before, last)
            full |= settled
            self._discard(earlier)
            if not last:
                dropped = set(self._determined(sampled, before)) | self._followed(candidates)
        self.bounds |= {c: self.table.n_rows - excess for c, excess in full.items()}
        uccs = [c for c in candidates if full.get(c) == 0]
        if last:
            return uccs, Level({})
        kept = {
            c: sampled.get(c)
            for c in candidates
            if full.get(c) != 0
            and c not in dropped
            and not (c in full and self._followers(c, full[c], before.in_full))
        }
        return uccs, Level(kept, full, pool)

    def _too_few_keys(self, combo: Combo) -> bool:
        """Known counts leave fewer different keys than rows: the combination repeats, without a job."""
        missing = sum(self.nulls[col] for col in combo) if self.skip_nulls else 0
        return cover_bound(combo, self.bounds) < self.table.n_rows - missing

    def _determined(self, sampled: dict[Combo, int], before: Level) -> dict[Combo, list[Combo]]:
        """Combinations in which one column follows from the rest, where the sample leaves that open."""
        suspects = {c: self._followers(c, sampled[c], before.in_sample) for c in sampled if sampled[c]}
        for c, parts in suspects.items():
            suspects[c] = [p for p in parts if self.pivots.follows(p, (set(c) - set(p)).pop()) is None]
        return waves.determined(self.table, {c: parts for c, parts in suspects.items() if parts}, self.skip_nulls)

    def _compared(self, combo: Combo) -> bool:
        """All that the sample could say of the combination and of its parts is known from pairs of rows."""
        return self.pivots.holds_all(combo) and all(
            self.pivots.follows(tuple(x for x in combo if x != c), c) is not None for c in combo if self._always_counts(c)
        )

    def _followed(self, candidates: list[Combo]) -> set[Combo]:
        """Combinations in which one column follows from the rest, as all pairs of rows show."""
        rest = {c: [(tuple(x for x in c if x != col), col) for col in c if self._always_counts(col)] for c in candidates}
        return {c for c, parts in rest.items() if any(self.pivots.holds_all(p) and self.pivots.follows(p, col) for p, col in parts)}

    def _by_pivots(self, combos: list[Combo], before: Level) -> tuple[list[Combo], dict[Combo, int]]:
        """The combinations that agree sets leave open, and the excess of those that they show to be unique.

        Pivots are added while one answers for two or more of the combinations that no pool holds.
        Pairs of columns are counted, which leaves pools.
        """
        while combos and len(combos[0]) > 2:
            lone = [c for c in combos if self.pivots.of(c) is None and self._parent(c, before.pool) is None]
            lone = [c for c in lone if not self.pivots.repeats(c)]
            chosen = self.pivots.choose(lone) if len(lone) > 1 else None
            if not chosen:
                break
            self.pivots.run(chosen)
        combos = [c for c in combos if not self.pivots.repeats(c)]
        unique, still, asked = [], [], {}
        for c in combos:
            pivot = self.pivots.of(c)
            if pivot is None:
                still.append(c)
            elif pivot.rest is None:
                unique.append(c)
            else:
                asked.setdefault(pivot.combo, (pivot.rest, []))[1].append(c)
        for rows, open_combos in asked.values():
            found = waves.repeats(rows, open_combos, self.skip_nulls, lambda s: s.rows > 0, self.held)
            unique += [c for c in open_combos if c not in found.refuted and not found.counts[c].rows]
        return still, dict.fromkeys(unique, 0)

    # -- counting in full ------------------------------------------------------

    def _count_survivors(self, combos: list[Combo], before: Level, last: bool) -> tuple[dict[Combo, int], Pool | None]:
        """Excess of combinations without a repeat in the sample, on as few rows as possible."""
        pool = before.pool
        parent = {c: self._parent(c, pool) for c in combos}
        pooled = [c for c in combos if parent[c] is not None]
        fresh = [c for c in combos if parent[c] is None]
        position = {slot: i for i, slot in enumerate(self.slots)}
        excess: dict[Combo, int] = {}
        kept = Pool(None, {}, {})
        parts: list[DataFrame] = []

        def add(rows, batch, batch_owners, keys, counts) -> None:
            """Put the rows of the batch's repeated keys into the next pool, as far as there is room."""
            usable = [] if last else self._poolable(counts, self.table.n_rows // POOLS_SHARE - sum(kept.n_rows.values()))
            if not usable:
                return
            first = len(kept.owners)
            new_owner = {i: first + n for n, i in enumerate(usable)}
            kept.owners.update({batch[i]: owner for i, owner in new_owner.items()})
            kept.n_rows.update({batch[i]: counts[i].rows for i in usable})
            layout = self.table.layout([batch[i] for i in usable])
            own = [batch_owners[i] for i in usable]
            parts.append(_repeated_rows(rows, layout, position, own, keys.where(F.col("combo").isin(usable)), new_owner))

        for batch in _batches(pooled, [pool.n_rows[parent[c]] for c in pooled], most_cells(self.table.n_rows)):
            owners = [pool.owners[parent[c]] for c in batch]
            with roomy(self.spark, sum(pool.n_rows[parent[c]] for c in batch)):
                cells = _pool_cells(pool.rows, self.table.layout(batch), position, owners, self.skip_nulls)
                keys = durable(G.sizes(cells).where(F.col("size") > 1))
                self.held.append(keys)
                counts = G.read_counts(G.summary(keys), len(batch))
            excess.update({c: s.excess for c, s in zip(batch, counts)})
            add(pool.rows, batch, owners, keys, counts)
        if fresh:
            most = 0 if last else self.table.n_rows // POOL_SHARE
            found = waves.repeats(self.table, fresh, self.skip_nulls, lambda s: s.rows > most, self.held)
            excess.update({c: s.excess for c, s in found.counts.items() if c not in found.refuted})
            whole = self.table.frame.select(
                F.lit(0).alias("owner"), F.array(*[F.col(f"s{slot}") for slot in self.slots]).alias("codes")
            )
            if found.keys:
                counts = [G.NOTHING if c in found.refuted else found.counts[c] for c in fresh]
                add(whole, fresh, [0] * len(fresh), reduce(DataFrame.unionByName, found.keys), counts)
        if not parts:
            return excess, None
        # Written once: later levels must not fall back on the full passes behind it.
        kept.rows = durable(reduce(DataFrame.unionByName, parts))
        return excess, kept

    def _poolable(self, counts: list[Counts], spare: int) -> list[int]:
        """Combinations with few repeated rows, fewest keys first.

        As many as leave all keys small enough to broadcast and all rows within ``spare``.
        """
        usable, room = [], BROADCAST_ROWS
        for i, s in sorted(enumerate(counts), key=lambda x: x[1].groups):
            if s.rows and s.rows * POOL_SHARE <= self.table.n_rows and s.groups <= room and s.rows <= spare:
                usable.append(i)
                room -= s.groups
                spare -= s.rows
        return sorted(usable)

    def _parent(self, combo: Combo, pool: Pool | None) -> Combo | None:
        if pool is None:
            return None
        smaller = [tuple(x for x in combo if x != c) for c in combo]
        known = [p for p in smaller if p in pool.owners]
        return min(known, key=lambda p: pool.n_rows[p], default=None)


def _joined(kept: Sequence[Combo]) -> list[Combo]:
    """What next_candidates() gives for combinations of one size."""
    known, by_prefix = set(kept), {}
    for c in sorted(kept):
        by_prefix.setdefault(c[:-1], []).append(c[-1])
    joined = ((*prefix, i, j) for prefix, lasts in by_prefix.items() for i, j in combinations(lasts, 2))
    return sorted(c for c in joined if all(c[:k] + c[k + 1 :] in known for k in range(len(c) - 2)))


def _batches(combos: Sequence[Combo], cells: Sequence[int], most: int) -> list[list[Combo]]:
    """The combinations in parts of at most so many cells, if a single one has no more."""
    out, room = [], -1
    for c, n in zip(combos, cells):
        if n > room:
            out.append([])
            room = most
        out[-1].append(c)
        room -= n
    return out


def _pool_cells(rows, layout, position, owners, skip_nulls, carry=()) -> DataFrame:
    """Cells of the rows whose owner the combination is to be checked on."""
    depth = G.depth_of(layout)
    plan = G.plan_of(layout, position, range(len(layout)), owners)
    own = F.filter(plan, lambda e: e["owner"] == F.col("owner")) if len(set(owners)) > 1 else plan
    source = rows if len(set(owners)) > 1 else rows.where(F.col("owner") == owners[0])
    exploded = source.select("owner", "codes", F.explode(own).alias("entry"))
    keyed = exploded.select("entry", "codes", *G.keys_at(F.col("codes"), "entry", depth))
    if skip_nulls:
        keyed = keyed.where(G.complete("entry", depth))
    return keyed.select(F.col("entry.combo").alias("combo"), *G.key_names(depth), *carry)


def _repeated_rows(rows, layout, position, owners, repeated, new_owner) -> DataFrame:
    """(owner, codes) of the rows whose key is among the repeated ones; those can be broadcast."""
    depth = G.depth_of(layout)
    keyed = _pool_cells(rows, layout, position, owners, False, carry=("codes",))
    numbered = sorted(new_owner)  # cell number n stands for combination numbered[n]
    keys = repeated.select(
        F.col("combo").alias("c"), *[F.col(k).alias(f"r_{k}") for k in G.key_names(depth)]
    )
    number = F.array_position(F.array(*[F.lit(i) for i in numbered]), F.col("c")).cast("int") - 1
    keys = F.broadcast(keys.withColumn("c", number))
    same = F.col("combo") == F.col("c")
    for k in G.key_names(depth):
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    hit = keyed.join(keys, same, "left_semi")
    base = min(new_owner.values())
    return hit.select((F.col("combo") + base).alias("owner"), "codes")
