"""Upper bounds for the distinct keys of a combination, from counts that are known."""

from __future__ import annotations

from collections.abc import Mapping
from math import prod

from solekey.plans.groups import Combo

# Combinations of up to this many columns are covered in the best way, larger ones column by column.
BEST_COVER = 12


def cover_bound(combo: Combo, counted: Mapping[Combo, int]) -> float:
    """The least product of counts over counted subsets that together hold all columns of `combo`.

    A combination has at most as many keys as its parts have together; without a cover the
    bound is infinite. `counted` maps sorted combinations to upper bounds of their keys.
    """
    k = len(combo)
    if k > BEST_COVER:
        return prod(counted.get((c,), float("inf")) for c in combo)
    count = [0.0] * (1 << k)
    for mask in range(1, 1 << k):
        count[mask] = counted.get(tuple(c for i, c in enumerate(combo) if mask >> i & 1), float("inf"))
    best = [1.0] + [float("inf")] * ((1 << k) - 1)
    for mask in range(1, 1 << k):
        rest = mask & (mask - 1)  # the lowest column is in the part that is split off
        part = rest
        while True:
            best[mask] = min(best[mask], count[mask ^ part] * best[part]) if best[part] < float("inf") else best[mask]
            if not part:
                break
            part = (part - 1) & rest
    return best[-1]
