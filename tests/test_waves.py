"""Waves, bounds, coherent samples and the order of columns."""

import os
import random
import time
from itertools import combinations
from math import prod

import pytest
from brute import group_counts, is_unique, minimal_uccs
from pyspark.sql import functions as F

from solekey import session
from solekey.operators.frames import combination_frame
from solekey.operators.lattice import join_prefixes
from solekey.plans import coded, search, waves
from solekey.plans import groups as G
from solekey.plans.bounds import cover_bound

LINEITEM = "/root/testdata/sf0.01/lineitem.parquet"


def coded_rows(spark, rows, types=None):
    types = types or ["int"] * len(rows[0])
    return coded.code_table(spark.createDataFrame(rows, ", ".join(f"c{i} {t}" for i, t in enumerate(types))), stats=False)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(session, "CELLS_PER_PARTITION", 100)


def spied_reads(monkeypatch):
    reads = []
    frame = coded.CodedTable.frame

    monkeypatch.setattr(coded.CodedTable, "frame", property(lambda self: reads.append(1) or frame.fget(self)))
    return reads


def test_reads_of_a_level_do_not_grow_with_its_combinations(spark, monkeypatch, tiny):
    rng = random.Random(1)
    table = coded_rows(spark, [(i, 2000 - i, *[rng.randrange(40) for _ in range(9)]) for i in range(2000)])
    unique = [(0, *c) for size in (1, 2, 3) for c in combinations(range(2, 11), size)]
    assert session.room(spark) < table.n_rows  # the cells of a single combination are too many for one job
    reads = spied_reads(monkeypatch)
    took = []
    for asked in (unique[:2], unique[:20], unique):
        del reads[:]
        held = []
        found = waves.repeats(table, asked, False, lambda s: s.rows > 0, held)
        assert not found.refuted and all(s.excess == 0 for s in found.counts.values())
        assert [len(w) for w in found.seen] == [len(asked)] * len(waves.ENDS)
        took.append(len(reads))
    assert took == [len(waves.ENDS)] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    del reads[:]
    counted = table.counts(unique, False)
    assert len(reads) == 1 and all(counted[c].is_unique for c in unique)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_refuted_combinations_leave_the_next_waves(spark, tiny):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(900), i if i > 3 else 3) for i in range(1500)]
    table = coded_rows(spark, rows)
    asked = [(0, 1), (1, 2), (1, 3), (2, 3)]
    found = waves.repeats(table, asked, False, lambda s: s.rows > 0, [])
    sizes = [len(w) for w in found.seen]
    assert sizes[0] == 4 and sizes[-1] < 4 and sizes == sorted(sizes, reverse=True)
    assert (1, 2) not in found.seen[1]  # repeats in every slice
    for c in asked:
        repeats = c in found.refuted or found.counts[c].excess > 0
        assert repeats == (not is_unique(rows, c))
    full = waves.repeats(table, asked, False, lambda s: False, [])
    assert not full.refuted
    for c in asked:
        groups = group_counts(rows, c)
        assert full.counts[c].excess == len(rows) - len(groups)
        assert full.counts[c].repeated_groups == sum(n > 1 for n in groups.values())


@pytest.mark.parametrize("broadcast_rows", [0, 10, 10_000])
def test_more_repeated_hashes_than_can_be_broadcast(spark, monkeypatch, tiny, broadcast_rows):
    monkeypatch.setattr(waves, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(waves, "WITNESSES", 3)
    rng = random.Random(3)
    rows = [(rng.randrange(400), rng.randrange(300), i) for i in range(1000)]
    table = coded_rows(spark, rows)
    found = waves.repeats(table, [(0,), (1,), (0, 1), (2,)], False, lambda s: s.rows > 0, [])
    for c, s in found.counts.items():
        assert (c in found.refuted or s.excess > 0) == (not is_unique(rows, c))


@pytest.mark.parametrize("nulls", [False, True])
def test_columns_that_follow_from_others(spark, tiny, nulls):
    rng = random.Random(4)
    rows = []
    for _ in range(700):
        a, b = rng.randrange(20), rng.randrange(30)
        rows.append((a, b, a % 5, f"{a}-{b}", (a * 31 + b) % 7, None if a % 4 == 0 else a // 2))
    table = coded_rows(spark, rows, ["int", "int", "int", "string", "int", "int"])
    triples = list(combinations(range(6), 3))
    suspects = {c: [tuple(x for x in c if x != b) for b in c if not (nulls and b == 5)] for c in triples}
    found = waves.determined(table, suspects, nulls)
    mode = "distinct" if nulls else "equal"
    for c, parts in suspects.items():
        seen = [r for r in rows if not (nulls and None in (r[x] for x in c))]
        same = [p for p in parts if len(group_counts(seen, c, mode)) == len(group_counts(seen, p, mode))]
        assert found.get(c, []) == same


def test_a_part_that_leaves_does_not_move_the_slices_of_others(spark, tiny):
    """Before, a part's slices hung on its place among those left, so some keys were looked at in no wave."""
    first = waves.in_slice(F.xxhash64(F.lit(0), "id"), 0, 1)
    late = ~waves.in_slice(F.xxhash64(F.lit(1), "id"), 0, 1)
    odd = spark.range(700).where(first & late).first()["id"]
    rows = [(i % 700, i % 7 if i != 700 + odd else 9, i // 2, i % 2) for i in range(1400)]
    table = coded_rows(spark, rows)
    assert len(waves.plan(table, 2)) > 1
    assert waves.determined(table, {(2, 3): [(2,)], (0, 1): [(0,)]}, False) == {}


@pytest.mark.parametrize("skip_nulls", [False, True])
def test_a_wave_has_few_cells_on_disk(spark, monkeypatch, tiny, skip_nulls):
    """Before, a wave shuffled the cells of all its combinations at once: over 3 GB for 3.6 million rows of lineitem."""
    monkeypatch.setattr(session, "CELLS_ON_DISK", 1)
    rng, made, cells = random.Random(6), [], G.cells
    rows = [tuple(None if rng.random() < 0.02 else rng.randrange(n) for n in (90, 70, 50, 8, 6)) for _ in range(400)]
    table = coded_rows(spark, rows)
    monkeypatch.setattr(G, "cells", lambda frame, layout, *more, **named: made.append(len(layout)) or cells(frame, layout, *more, **named))
    every = [c for size in (2, 3) for c in combinations(range(5), size)]
    found = waves.repeats(table, every, skip_nulls, lambda s: False, [])
    assert made[-1] == 1 and len(made) > len(waves.ENDS)
    mode = "distinct" if skip_nulls else "equal"
    for c in every:
        groups = group_counts(rows, c, mode)
        assert found.counts[c].excess == sum(n - 1 for n in groups.values())
    assert table.counts(every, skip_nulls)[every[0]].groups == len(group_counts(rows, every[0], mode)) and made[-1] == 1


def test_a_search_with_few_cells_on_disk(spark, monkeypatch, tiny):
    monkeypatch.setattr(session, "CELLS_ON_DISK", 1)
    rng = random.Random(7)
    rows = [(i // 3, rng.randrange(60), *[rng.randrange(n) for n in (9, 5, 4)], i // 3 % 5) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(6)))
    assert set(search.find(df, sample_rows=40)[0]) == set(minimal_uccs(rows, 6))


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


@pytest.mark.parametrize("parts", [1, 4])
def test_shuffle_files_go_with_their_job(spark, monkeypatch, parts):
    """Before, they stayed until the driver's memory was cleaned up."""
    monkeypatch.setattr(session, "ROWS_PER_CORE", 10)  # too many rows to be spread and kept as a small table
    keys = [session.SHUFFLE_CLEANUP, session.READ_BYTES]
    before, settings = shuffle_files(spark), [spark.conf.get(k, None) for k in keys]
    rows = [(i // 4, i % 50, i % 7, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").coalesce(parts)
    for method in search.METHODS:
        search.find(df, sample_rows=40, method=method)
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert [spark.conf.get(k, None) for k in keys] == settings


def test_files_are_read_in_small_parts(spark, monkeypatch, tmp_path):
    """Before, a search shuffled all codes anew for each wave where tasks read many rows."""
    monkeypatch.setattr(session, "ROWS_PER_CORE", 10)
    monkeypatch.setattr(session, "ROWS_READ", 150)
    spark.range(2000).repartition(20).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.rows_and_largest(df)[1] > 150
    with session.fine_reads(df):
        assert session.rows_and_largest(df) == (2000, 100)
    assert session.rows_and_largest(df)[1] > 150


def test_cover_bound():
    rng = random.Random(5)
    for _ in range(200):
        rows = [tuple(rng.randrange(rng.choice([1, 2, 5, 9])) for _ in range(5)) for _ in range(40)]
        every = [c for size in range(1, 5) for c in combinations(range(5), size)]
        counted = {c: len(group_counts(rows, c)) for c in rng.sample(every, 8)}
        target = tuple(range(5))
        assert cover_bound(target, counted) >= len(group_counts(rows, target))
    counted = {(0,): 10, (1,): 10, (2,): 3, (0, 1): 12}
    assert cover_bound((0, 1, 2), counted) == 36
    assert cover_bound((0, 3), counted) == float("inf")
    wide = {(c,): 2 for c in range(20)}
    assert cover_bound(tuple(range(20)), wide) == prod([2] * 20)


def test_bounds_save_jobs(spark, monkeypatch):
    """Columns of few values: the last level asks nothing of the table or the sample."""
    rows = [(i % 10, i // 10 % 10, i // 100 % 10, i // 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    asked = []
    counts = coded.CodedTable.counts

    def spy(self, combos, *args, **more):
        asked.extend(combos)
        return counts(self, combos, *args, **more)

    monkeypatch.setattr(coded.CodedTable, "counts", spy)
    found, names = search.find(df, max_arity=3, sample_rows=300)
    assert [names[c[0]] for c in found] == ["e"]
    assert not [c for c in asked if len(c) == 3]
    bounded = len(asked)
    monkeypatch.setattr(search, "FEW_VALUES", 0)
    del asked[:]
    assert search.find(df, max_arity=3, sample_rows=300)[0] == found
    assert len(asked) > bounded


@pytest.mark.skipif(not os.path.exists(LINEITEM), reason="no test tables here")
def test_columns_of_many_values_first(spark, monkeypatch):
    """The same answer as in table order, from fewer joined pairs."""
    df = spark.read.parquet(LINEITEM)
    kept = []
    candidates = search._Search._candidates

    def spy(self, level):
        kept.append((list(self.table.names), list(level.in_sample)))
        return candidates(self, level)

    monkeypatch.setattr(search._Search, "_candidates", spy)
    found, names = search.find(df, max_arity=3)
    own, other = 0, 0
    for order, combos in kept:
        there = [tuple(sorted(names.index(order[c]) for c in combo)) for combo in combos]
        own += join_prefixes(combination_frame(spark, combos)).count()
        other += join_prefixes(combination_frame(spark, there)).count()
    assert own < other
    monkeypatch.setattr(coded.CodedTable, "profile", lambda self: [(0, 10**6)] * len(self.names))
    assert set(search.find(df, max_arity=3)[0]) == set(found)


@pytest.mark.skipif(not os.path.exists(LINEITEM), reason="no test tables here")
def test_coherent_sample_refutes_more(spark):
    df = spark.read.parquet(LINEITEM)
    table = coded.code_table(df, stats=False)
    profile = table.profile()
    order = sorted(range(len(profile)), key=lambda c: -profile[c][1])
    table.reorder(order)
    looking = search._Search(table, False, None, 2000, [profile[c] for c in order])
    looking._take_sample()
    looking.slots = list(range(len(table.exprs)))
    triples = list(combinations(range(len(order)), 3))
    uniform = {c for c, s in looking._sample_counts(triples).items() if s.excess}
    left = looking._refute(triples)
    truth = {c for c, s in table.counts(triples, False).items() if not s.is_unique}
    coherent = set(triples) - set(left)
    drawn = {c for c in triples if (c[0],) in looking.coherent.owners}
    assert coherent <= truth and drawn
    assert max(looking.coherent.n_rows.values()) <= search.COHERENT_EXCESS * 2000
    assert len(coherent) > len(uniform & drawn)
