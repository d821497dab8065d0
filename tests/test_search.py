import random

import pytest
from brute import is_unique, minimal_uccs as brute

from solekey import session
from solekey.operators.frames import combination_frame
from solekey.operators.lattice import next_candidates
from solekey.plans import search, waves
from solekey.plans.search import find, minimal_uccs


def frame(spark, rows, width, types=None):
    names = [f"c{i}" for i in range(width)]
    types = types or ["string"] * width
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def answer(df, **options):
    return {tuple(c) for c in find(df, **options)[0]}


def strings(seed, n, sizes, holes=0.0):
    """Rows of short texts from a seed, column i with about sizes[i] values; some fields empty."""
    rng = random.Random(seed)
    rows = [tuple(None if rng.random() < holes else f"v{rng.randrange(k)}" for k in sizes) for _ in range(n)]
    return list(dict.fromkeys(rows))


# Five hundred readings with keys of two to five columns, and sixty with empty fields.
READINGS = strings(101, 500, [400, 90, 40, 12, 7, 5])
SPARSE = strings(202, 60, [40, 25, 9, 6, 6, 4, 3, 3], holes=0.15)

CASES = [READINGS, SPARSE]


@pytest.mark.parametrize("rows", CASES)
def test_known_answers(spark, rows):
    expected = set(brute(rows, len(rows[0])))
    assert max(map(len, expected)) >= 3
    assert answer(frame(spark, rows, len(rows[0]))) == expected


def test_wide_table_with_constant_and_equivalent_columns(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        own = [rng.randrange(4) for _ in range(8)] + [rng.randrange(9) for _ in range(4)]
        same = [own[0] * 7 + 1, own[1] + 100, 3 - own[2], own[8] * 2]
        rows.append((*own, *same, "x", "y", "z", 0, i % 30, i // 2, own[0] + own[1], own[4] // 2))
    text = [tuple(str(v) for v in r) for r in rows]
    assert len(text[0]) == 24
    assert answer(frame(spark, text, 24), max_arity=4) == set(brute(text, 24, 4))


def test_pairwise_repeats_do_not_make_a_triple_repeat(spark):
    rows = [("x", 1, 1), ("x", 1, 2), ("x", 2, 2), ("y", 2, 1), ("y", 1, 1)]
    assert answer(frame(spark, rows, 3, ["string", "int", "int"])) == {(0, 1, 2)}


def test_constant_and_equivalent_columns(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        a, b, c = rng.randrange(12), rng.randrange(9), rng.randrange(9)
        rows.append((a, 7, b, f"b{b}", c, -a, 1, c * 3))
    rows = list(dict.fromkeys(rows))
    df = frame(spark, rows, 8, ["int", "int", "int", "string", "int", "int", "int", "int"])
    assert answer(df) == set(brute(rows, 8))
    assert answer(df, sample_rows=15) == set(brute(rows, 8))


def test_public_form(spark):
    rows = [(i % 6, i // 6, i) for i in range(24)]
    out = minimal_uccs(frame(spark, rows, 3, ["int"] * 3))
    assert out.columns == ["ucc", "columns", "arity"]
    assert {(r.ucc, tuple(r.columns), r.arity) for r in out.collect()} == {
        ("c2", ("c2",), 1),
        ("c0,c1", ("c0", "c1"), 2),
    }


@pytest.mark.parametrize("rows, expected", [([], {(0,), (1,)}), ([("a", "b")], {(0,), (1,)}), ([("a", "b")] * 3, set())])
def test_degenerate_tables(spark, rows, expected):
    assert answer(frame(spark, rows, 2)) == expected


def test_repeated_rows_leave_only_other_keys(spark):
    rows = [(i, i % 5, i % 5, "x") for i in range(40)]
    assert answer(frame(spark, rows, 4, ["int", "int", "int", "string"])) == {(0,)}


def test_all_null_column(spark):
    rows = [(None, 1, 1), (None, 1, 2), (None, 2, 2)]
    df = frame(spark, rows, 3, ["string", "int", "int"])
    assert answer(df) == {(1, 2)}
    assert answer(df, nulls="distinct") == {(0,), (1, 2)}


def test_wide_table(spark):
    rows = [(*[i % 2] * 65, i // 10, i % 10) for i in range(100)]
    assert answer(frame(spark, rows, 67, ["int"] * 67)) == {(65, 66)}


def table(seed):
    """Random rows with near-keys, copies of columns, constants and skew."""
    rng = random.Random(seed)
    n = rng.choice([120, 200, 300])
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        base = 0 if hot else rng.randrange(8)
        near = i if rng.random() > 0.06 else rng.randrange(n)
        wide = rng.randrange(n // 2)
        rows.append((base, near, wide, rng.randrange(6), base % 3, rng.randrange(12), f"v{wide // 2}"))
    return rows


def holes(rows, seed):
    rng = random.Random(seed)
    return [tuple(None if c in (1, 3, 6) and rng.random() < 0.1 else v for c, v in enumerate(r)) for r in rows]


TYPES = ["int", "bigint", "int", "int", "int", "int", "string"]


@pytest.mark.parametrize("seed, sample_rows", [(0, 12), (1, 12), (2, 60), (3, 12), (4, 60), (5, None)])
def test_random_tables_match_brute_force(spark, seed, sample_rows):
    rows = table(seed)
    df = frame(spark, rows, 7, TYPES).repartition(3)
    assert answer(df, sample_rows=sample_rows) == set(brute(rows, 7))


@pytest.mark.parametrize("seed, nulls, sample_rows", [(0, "equal", 40), (1, "distinct", 40), (2, "distinct", 15), (3, "distinct", None)])
def test_random_tables_with_nulls(spark, seed, nulls, sample_rows):
    rows = holes(table(seed + 20), seed)
    expected = set(brute(rows, 7, nulls=nulls))
    assert answer(frame(spark, rows, 7, TYPES), nulls=nulls, sample_rows=sample_rows) == expected


@pytest.mark.parametrize("max_arity", [1, 2, 3])
def test_arity_cap(spark, max_arity):
    rows = table(31)
    expected = set(brute(rows, 7, max_arity))
    assert answer(frame(spark, rows, 7, TYPES), max_arity=max_arity, sample_rows=30) == expected


def test_pools_are_used_and_exact(spark, monkeypatch):
    used = []
    parent = search._Search._parent

    def spy(self, combo, pool):
        found = parent(self, combo, pool)
        used.append(found)
        return found

    monkeypatch.setattr(search._Search, "_parent", spy)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        # Each pair of near-keys repeats in a few rows only, on purpose.
        k = i if i % 50 else 1
        rows.append((k, i if i % 40 else 2, rng.randrange(5), rng.randrange(5), i % 7))
    df = frame(spark, rows, 5, ["int"] * 5)
    assert answer(df, sample_rows=10) == set(brute(rows, 5))
    assert any(p is not None for p in used)


def test_pool_rows_of_a_level_are_bounded():
    looking = object.__new__(search._Search)
    looking.table = type("Table", (), {"n_rows": 1000})()
    few = search.Counts(20, 10, 2, 10, 20)
    assert looking._poolable([few] * 8, 1000) == list(range(8))
    assert looking._poolable([few] * 8, 45) == [0, 1]
    assert looking._poolable([few] * 8, 0) == []


@pytest.mark.parametrize("broadcast_rows", [0, 12])
def test_more_repeats_than_can_be_broadcast(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(search, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(waves, "BROADCAST_ROWS", broadcast_rows)
    rows = table(2)
    assert answer(frame(spark, rows, 7, TYPES), sample_rows=12) == set(brute(rows, 7))


def test_levels_joined_by_jobs(spark, monkeypatch):
    monkeypatch.setattr(search, "LOCAL_SETS", 0)
    rows = table(3)
    assert answer(frame(spark, rows, 7, TYPES), sample_rows=30) == set(brute(rows, 7))
    with pytest.raises(RuntimeError, match="candidates"):
        answer(frame(spark, rows, 7, TYPES), max_candidates=2)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_join_on_the_driver(spark, size):
    rng = random.Random(size)
    kept = [tuple(c) for c in {tuple(sorted(rng.sample(range(9), size))) for _ in range(60)}]
    found = next_candidates(combination_frame(spark, kept))
    assert search._joined(kept) == sorted(tuple(r.cols) for r in found.collect())


@pytest.mark.parametrize("max_arity", [None, 3])
def test_many_waves(spark, monkeypatch, max_arity):
    monkeypatch.setattr(session, "CELLS_PER_PARTITION", 50)
    rows = table(4)
    found = answer(frame(spark, rows, 7, TYPES), sample_rows=30, max_arity=max_arity)
    assert found == set(brute(rows, 7, max_arity))


def test_result_is_minimal_antichain(spark):
    rows = table(9)
    found = answer(frame(spark, rows, 7, TYPES))
    for c in found:
        assert is_unique(rows, c)
        assert all(not is_unique(rows, [x for x in c if x != y]) for y in c if len(c) > 1)
        assert not any(set(o) < set(c) for o in found)


def test_candidate_guard_raises(spark):
    rows = table(1)
    with pytest.raises(RuntimeError, match="candidates"):
        answer(frame(spark, rows, 7, TYPES), max_candidates=2)


def test_rejected_types(spark):
    df = spark.sql("select map('a', 1) m, 1 x")
    with pytest.raises(TypeError, match="grouping equality"):
        minimal_uccs(df)
    with pytest.raises(ValueError):
        minimal_uccs(spark.range(3), nulls="maybe")
