"""Exact uniqueness of chosen column combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from solekey.operators.frames import local_frame
from solekey.plans.coded import check_nulls, code_table


def check_combinations(df: DataFrame, combos: Sequence[Sequence[str]], nulls: str = "equal") -> DataFrame:
    """One row per combination: ucc, n_rows, n_distinct, max_multiplicity, is_unique.

    Only the columns that occur in a combination are read.
    """
    skip_nulls = check_nulls(nulls)
    if any(len(set(combo)) != len(combo) or not combo for combo in combos):
        raise ValueError("a combination must name at least one column, and none twice")
    used = [c for c in df.columns if any(c in combo for combo in combos)]
    unknown = {c for combo in combos for c in combo} - set(used)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    table = code_table(df, used, stats=False)
    keys = list(dict.fromkeys(tuple(sorted(used.index(c) for c in combo)) for combo in combos))
    found = table.counts(keys, skip_nulls)
    rows = [
        (",".join(used[c] for c in k), found[k].rows, found[k].groups, found[k].largest, found[k].is_unique)
        for k in keys
    ]
    return local_frame(
        df.sparkSession,
        rows,
        "ucc string, n_rows bigint, n_distinct bigint, max_multiplicity bigint, is_unique boolean",
    )
