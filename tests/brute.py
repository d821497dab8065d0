"""Answers by trying every combination in plain Python; an independent check."""

from collections import Counter
from itertools import combinations


def group_counts(rows, combo, nulls="equal"):
    keys = [tuple(r[c] for c in combo) for r in rows]
    if nulls == "distinct":
        keys = [k for k in keys if None not in k]
    return Counter(keys)


def is_unique(rows, combo, nulls="equal"):
    return all(n == 1 for n in group_counts(rows, combo, nulls).values())


def minimal_uccs(rows, width, max_arity=None, nulls="equal"):
    found = []
    for size in range(1, (max_arity or width) + 1):
        for combo in combinations(range(width), size):
            if not any(set(f) <= set(combo) for f in found) and is_unique(rows, combo, nulls):
                found.append(combo)
    return found
