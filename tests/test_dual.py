"""The search through agree sets, and searches that are taken up again."""

import os
import random

import pytest
from brute import minimal_uccs as brute
from test_search import TYPES, answer, frame, holes, table

from solekey.plans import dual, search
from solekey.session import shared_dir


def test_hitting_sets():
    rng = random.Random(1)
    for _ in range(200):
        width = rng.randint(1, 7)
        agreeing = [rng.randrange(1 << width) for _ in range(rng.randint(0, 6))]
        got = dual.minimal_hitting_sets(agreeing, width)
        free = [m for m in range(1 << width) if not any(m & ~a == 0 for a in agreeing)]
        assert sorted(got) == sorted(m for m in free if not any(o != m and o & ~m == 0 for o in free))
        small = dual.minimal_hitting_sets(agreeing, width, 2)
        assert sorted(small) == sorted(m for m in got if m.bit_count() <= 2)


@pytest.mark.parametrize("seed, sample_rows", [(0, 12), (1, 1), (2, 60), (3, None)])
def test_dual_matches_brute_force(spark, seed, sample_rows):
    rows = table(seed)
    assert answer(frame(spark, rows, 7, TYPES), method="dual", sample_rows=sample_rows) == set(brute(rows, 7))


@pytest.mark.parametrize("nulls", ["equal", "distinct"])
def test_dual_with_nulls_and_cap(spark, nulls):
    rows = holes(table(27), 7)
    df = frame(spark, rows, 7, TYPES)
    assert answer(df, method="dual", nulls=nulls, sample_rows=30) == set(brute(rows, 7, nulls=nulls))
    assert answer(df, method="dual", nulls=nulls, sample_rows=30, max_arity=2) == set(brute(rows, 7, 2, nulls=nulls))


@pytest.mark.parametrize("rows, expected", [([], {(0,), (1,)}), ([("a", "b")], {(0,), (1,)}), ([("a", "b")] * 3, set())])
def test_dual_of_degenerate_tables(spark, rows, expected):
    assert answer(frame(spark, rows, 2), method="dual") == expected


def test_dual_of_a_wide_table(spark):
    """Thirty columns whose keys have three columns or more: few sets are asked, unlike level by level."""
    rng = random.Random(3)
    rows = [tuple(rng.randrange(2 if c < 26 else 12) for c in range(30)) for _ in range(120)]
    df = frame(spark, rows, 30, ["int"] * 30)
    found = answer(df, method="dual", max_arity=4)
    assert found == answer(df, max_arity=4) and found
    with pytest.raises(RuntimeError, match="candidates"):
        answer(df, method="dual", max_candidates=3)


def test_a_stopped_search_goes_on(spark, monkeypatch):
    rows = table(4)
    df = frame(spark, rows, 7, TYPES)
    expected = set(brute(rows, 7))
    folder = f"{shared_dir(spark)}/solekey-search-mine".removeprefix("file:")
    check, sizes = search._Search._check, []

    def stops(self, candidates, before, last):
        sizes.append(len(candidates[0]))
        if len(candidates[0]) == 3:
            raise KeyboardInterrupt
        return check(self, candidates, before, last)

    monkeypatch.setattr(search._Search, "_check", stops)
    with pytest.raises(KeyboardInterrupt):
        search.find(df, sample_rows=40, resume="mine")
    assert sizes == [2, 3] and os.path.isdir(folder)

    def goes_on(self, candidates, before, last):
        sizes.append(len(candidates[0]))
        return check(self, candidates, before, last)

    monkeypatch.setattr(search._Search, "_check", goes_on)
    with pytest.raises(ValueError, match="another table"):
        search.find(df.limit(100), sample_rows=40, resume="mine")
    del sizes[:]
    assert {tuple(c) for c in search.find(df, sample_rows=40, resume="mine")[0]} == expected
    assert sizes[0] == 3  # the pairs are not checked again
    assert not os.path.isdir(folder)
    with pytest.raises(ValueError):
        search.find(df, resume="a/b")
