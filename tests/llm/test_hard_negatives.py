"""Hard negatives against brute force, on made-up vectors of many shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solekey.llm import hard_negatives

SCHEMA = "vec_id long, label int, vector array<float>, leaf string, salt string, score string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def brute(rows, n_positives=5, n_negatives=10):
    rows = [(i, l, [int(np.floor(256 * x)) for x in v]) for i, l, v in rows if i is not None and l is not None
            and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, label, q in {r[0]: r for r in sorted(rows, key=lambda r: r[0])}.values():
        if i % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j, l) for j, l, v in rows if j != i]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:n_positives]:
            hits = sorted(s for s in scored if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p)
            out |= {(i, pid, k, j, -p, -s) for k, (s, j, _) in enumerate(hits[:n_negatives], 1)}
    return out


def mined(spark, rows, **more):
    found = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, scale=256, **more)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    rows = [tuple(r[c] for c in names) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return {(*r[:4], int(r[4]), int(r[5])) for r in rows}


def vectors(rng, n, dim, labels, centres=20):
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    out = []
    for i in range(n):
        v = np.array([c + rng.gauss(0, 0.6) for c in middle[rng.randrange(centres)]])
        out.append((i, rng.randrange(labels), (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    return out


@pytest.mark.parametrize("n, dim, labels, centres", [(1200, 8, 3, 20), (600, 16, 40, 3)])
def test_same_as_brute_force(spark, monkeypatch, n, dim, labels, centres):
    for name, value in {"LEAF_ROWS": 20, "PART_ROWS": 16, "BLOCK_ANCHORS": 8, "WALKERS": 7}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(hard_negatives, "MAX_FAN", 8)
    monkeypatch.setattr(hard_negatives, "SAMPLE_CELLS", 1)
    rng = random.Random(n)
    rows = vectors(rng, n, dim, labels, centres)
    rows += [(n + i, rng.randrange(labels), rows[7][2]) for i in range(150)]  # copies of one vector
    rows += [(n + 200 + i, i % 2, [5 * x for x in rows[i][2]]) for i in range(30)]  # other lengths
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = vectors(rng, 120, 4, 3)
    odd = [(200, None, [1.0] * 4), (210, 1, None), (220, 1, [1.0, None, 1.0, 1.0]), (230, 1, [float("nan")] * 4)]
    odd += [(240, 2, [float("inf")] * 4), (None, 1, [1.0] * 4), (250, 1, []), (260, 1, [0.0] * 4), (270, 9, [1.0, 0.5])]
    assert mined(spark, rows + odd) == brute(rows + odd)
    assert mined(spark, []) == set()
    assert mined(spark, odd[:6]) == set()
    one = [(10, 1, [1.0, 0.0]), (11, 1, [0.5, 0.0]), (12, 2, [0.2, 0.0]), (13, 2, [-1.0, 0.0])]
    assert mined(spark, one) == {(10, 11, 1, 12, 128 * 256, 51 * 256)}
    assert mined(spark, rows, n_positives=1) == brute(rows, n_positives=1)


def test_subtrees_are_passed_over():
    rng = random.Random(5)
    x = np.floor(256 * np.array([v for _, _, v in vectors(rng, 4000, 8, 2, 40)]))
    top = np.einsum("ij,ij->i", x, x).max()
    tree = hard_negatives.Tree(x[:1000], top, 12)
    ranges = {}
    leaf = tree.place(x, ranges)
    for node in tree.nodes:
        node.low, node.high = ranges.get(node.number, (node.low, node.high))
    q = x[:50]
    scores = q @ x.T
    least = np.sort(scores, axis=1)[:, -20:-19]
    whose, leaves = tree.reached(q, np.zeros_like(least), tree.radius(q, least))
    reached = set(zip(whose.tolist(), leaves.tolist()))
    assert all((k, leaf[j]) in reached for k, j in zip(*np.nonzero(scores >= least)))
    assert len(reached) < 0.5 * 50 * tree.leaves
