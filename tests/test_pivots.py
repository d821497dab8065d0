"""Agree sets of all rows that share a key, and the searches that rest on them."""

import random

import pytest
from brute import group_counts
from brute import minimal_uccs as brute
from test_search import TYPES, answer, frame, holes, table

from solekey import session
from solekey.plans import coded, dual, pivots, search
from solekey.plans.coded import code_table


def agreeing(rows, combo, skip_nulls=False):
    """Masks of all pairs of rows that agree on the combination."""
    same = lambda x, y: x == y and not (skip_nulls and x is None)
    masks = {
        sum(same(x, y) << i for i, (x, y) in enumerate(zip(a, b))) for k, a in enumerate(rows) for b in rows[:k]
    }
    return {m for m in masks if pivots.mask_of(combo) & ~m == 0}


@pytest.mark.parametrize("skip_nulls", [False, True])
def test_all_pairs_of_a_key_are_compared(spark, skip_nulls):
    rows = holes(table(5), 7)
    found = pivots.Pivots(code_table(frame(spark, rows, 7, TYPES), stats=False), skip_nulls)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for combo in [(0,), (1, 3)]:
            pivot = found.run(combo)
            assert pivot.masks == agreeing(rows, combo, skip_nulls) and pivot.complete and pivot.rest is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("skip_nulls", [False, True])
def test_keys_are_compared_slice_by_slice(spark, monkeypatch, skip_nulls):
    """Before, all codes of the table were on disk at once, in the order of the pivot."""
    monkeypatch.setattr(session, "CELLS_ON_DISK", 1)
    monkeypatch.setattr(pivots, "CODES_PER_CELL", 1)
    monkeypatch.setattr(pivots, "MOST_ROWS", 5)
    rows, made = holes(table(5), 7), []
    found = pivots.Pivots(code_table(frame(spark, rows, 7, TYPES), stats=False), skip_nulls)
    dealt = type(frame(spark, rows, 7, TYPES)).mapInArrow
    monkeypatch.setattr(type(found.table.frame), "mapInArrow", lambda self, *more: made.append(1) or dealt(self, *more))
    for combo in [(0,), (1, 3)]:
        pivot = found.run(combo)
        sizes = group_counts(rows, combo, "distinct" if skip_nulls else "equal")
        kept = [r for r in rows if sizes.get(tuple(r[c] for c in combo), 0) <= 5]
        assert pivot.masks == agreeing(kept, combo, skip_nulls)
    assert len(made) == 2 * len(found.table.exprs)


@pytest.mark.parametrize("method", ["levels", "dual"])
def test_keys_of_many_rows_are_grouped(spark, monkeypatch, method):
    monkeypatch.setattr(pivots, "MOST_ROWS", 3)
    monkeypatch.setattr(pivots, "MOST_SETS", 2)
    rows = holes(table(6), 7)
    df = frame(spark, rows, 7, TYPES)
    assert answer(df, method=method, nulls="distinct", sample_rows=12) == set(brute(rows, 7, nulls="distinct"))


def test_wide_tables_have_masks_of_several_words(spark):
    rng = random.Random(2)
    rows = [(i % 30, *[rng.randrange(3) for _ in range(69)]) for i in range(60)]
    found = pivots.Pivots(code_table(frame(spark, rows, 70, ["int"] * 70), stats=False), False)
    assert found.run((0,)).masks == agreeing(rows, (0,))


def keyed_rows():
    """Two keys with few rows each and columns of few values, whose unique sets have up to four columns."""
    rng = random.Random(8)
    return [(i // 4, rng.randrange(150), *[rng.randrange(n) for n in (7, 6, 5, 5)]) for i in range(600)]


def test_dual_asks_once_for_all_sets_of_a_key(spark, monkeypatch):
    """Before, every set that hits all agree sets was grouped over the whole table, round by round."""
    rows, asked, evidence = keyed_rows(), [], dual._evidence

    def spy(part, combos, skip_nulls):
        asked.extend(c for c in combos if part.n_rows == len(rows))
        return evidence(part, combos, skip_nulls)

    monkeypatch.setattr(dual, "_evidence", spy)
    found = answer(frame(spark, rows, 6, ["int"] * 6), method="dual", sample_rows=30)
    assert found == set(brute(rows, 6)) and len(found) > 4 and len(asked) < len(found)


def test_levels_ask_once_for_all_sets_of_a_key(spark, monkeypatch):
    """Before, every set of three columns or more without a repeat in the sample was grouped over the table."""
    rows, asked, repeats = keyed_rows(), [], search.waves.repeats

    def spy(part, combos, *rest):
        asked.extend(c for c in combos if len(c) > 2)
        return repeats(part, combos, *rest)

    monkeypatch.setattr(search, "POOL_SHARE", 10**6)  # no pools
    monkeypatch.setattr(search.waves, "repeats", spy)
    found = answer(frame(spark, rows, 6, ["int"] * 6), sample_rows=30)
    assert found == set(brute(rows, 6)) and len(asked) < len(found)


def test_cells_of_a_task_are_bounded(spark, monkeypatch):
    """A file of one row group is dealt out before its rows become cells."""
    df = spark.range(1000).coalesce(1).selectExpr("id a", "id % 7 b")
    codes = code_table(df, stats=False)
    monkeypatch.setattr(coded, "is_small", lambda *_: False)
    monkeypatch.setattr(coded, "spread", lambda df, n: df)
    monkeypatch.setattr(coded, "CELLS_PER_PARTITION", 100)
    assert codes.dealt(2000).rdd.getNumPartitions() == 20
    assert codes.counts([(0,), (1,), (0, 1)], False)[(0, 1)].groups == 1000


def test_a_table_read_by_one_task_is_dealt_once(spark, monkeypatch):
    """Before, each pass was made by the task that reads the file, with all keys in its memory."""
    monkeypatch.setattr(session, "ROWS_PER_CORE", 10)
    df = spark.range(1000).coalesce(1).selectExpr("id a", "cast(id % 7 as string) b", "id % 50 c")
    codes = code_table(df, reuse=True, stats=False)
    assert codes.uneven and codes.frame.rdd.getNumPartitions() == 100 and codes.largest == 10
    assert max(codes.frame.rdd.glom().map(len).collect()) < 40
    codes.release()
    assert codes.largest == 1000 and codes.frame.rdd.getNumPartitions() == 1


def test_few_cells_of_one_task_are_dealt(spark, monkeypatch):
    """Before, a task that read all rows kept them unless their cells needed more parts than there are cores."""
    monkeypatch.setattr(session, "ROWS_PER_CORE", 10)
    monkeypatch.setattr(coded, "CELLS_PER_PARTITION", 300)
    codes = code_table(spark.range(1000).coalesce(1).selectExpr("id a"), stats=False)
    assert codes.dealt(1000).rdd.getNumPartitions() == 4 and codes.dealt(200).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("method", ["levels", "dual"])
def test_uneven_tables_are_searched_whole(spark, monkeypatch, method):
    monkeypatch.setattr(session, "ROWS_PER_CORE", 5)
    rows = holes(table(6), 7)
    df = frame(spark, rows, 7, TYPES).coalesce(1)
    assert answer(df, method=method, sample_rows=12) == set(brute(rows, 7))


def test_pairs_are_estimated_from_a_sample(spark, monkeypatch):
    """Before, every row became a cell of every set that was measured."""
    monkeypatch.setattr(pivots, "MEASURED_FLOOR", 1000)
    monkeypatch.setattr(pivots, "MEASURED_PER_ROOT", 1)
    codes = code_table(spark.range(10_000).selectExpr("id % 1000 a", "id % 100 b", "id c"), stats=False)
    found = pivots.Pivots(codes, False)
    found._measure([(0,), (1,), (2,)])
    assert found.drawn.count() < 1500 and found.pairs[(2,)] == 0
    assert 3 < found.pairs[(0,)] < 6 and 40 < found.pairs[(1,)] < 60  # 4.5 and 49.5
