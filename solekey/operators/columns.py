"""What single columns look like: cells, repeated values, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.functions.combos import column
from solekey.functions.codes import needs_proof
from solekey.operators.frames import local_frame
from solekey.plans.coded import check_nulls, code_table, few_repeats, rows_with_repeated_codes


def cells(df: DataFrame, cols: Sequence[str] | None = None, row_id_col: str | None = None) -> DataFrame:
    """One row per cell: (row_id if asked for, column_name, value as text)."""
    cols = [c for c in df.columns if c != row_id_col] if cols is None else list(cols)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), column(c).cast("string").alias("value")) for c in cols]
    )
    ids = [] if row_id_col is None else [column(row_id_col).alias("row_id")]
    return df.select(*ids, F.explode(pairs).alias("cell")).select(*["row_id"][: len(ids)], "cell.*")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """How often each value of each column occurs: (column_name, value, cluster_size)."""
    return cells(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cluster_size"))


def value_clusters(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The values that occur more than once, per column.

    Where hardly any text of a column occurs twice, only those that may do so are
    shuffled: the others are told apart by their codes.
    """
    cols = list(df.columns if cols is None else cols)
    wide = [c for c in cols if needs_proof(df.schema[c].dataType)]
    if not wide:
        return value_counts(df, cols).where(F.col("cluster_size") > 1)
    table = code_table(df, wide, prove=False)
    rare = [c for i, c in enumerate(wide) if few_repeats(table, i) and table.nulls[i] * 4 <= table.n_rows]
    parts = []
    if len(rare) < len(cols):
        parts.append(value_counts(df, [c for c in cols if c not in rare]))
    for c in rare:
        likely = rows_with_repeated_codes(table, wide.index(c)).select(F.col("value").alias(c))
        empty = df.where(column(c).isNull()).select(column(c))
        parts.append(value_counts(likely.unionByName(empty) if table.nulls[wide.index(c)] else likely))
    return reduce(DataFrame.unionByName, parts).where(F.col("cluster_size") > 1)


def column_uniqueness(df: DataFrame, nulls: str = "equal", cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: n_rows, n_distinct, max_multiplicity, is_unique.

    With nulls="equal" all nulls of a column are one value; with nulls="distinct"
    rows where the column is null are left out.
    """
    skip_nulls = check_nulls(nulls)
    table = code_table(df, cols)
    stats = [table.column_counts(i, skip_nulls) for i in range(len(table.names))]
    rows = [(name, s.rows, s.groups, s.largest, s.is_unique) for name, s in zip(table.names, stats)]
    return local_frame(
        df.sparkSession,
        rows,
        "column_name string, n_rows bigint, n_distinct bigint, max_multiplicity bigint, is_unique boolean",
    )


def unique_columns(stats: DataFrame) -> DataFrame:
    """The columns that are minimal unique combinations by themselves."""
    return stats.where("is_unique")


def non_unique_columns(stats: DataFrame) -> DataFrame:
    """The columns that go on into the search."""
    return stats.where("NOT is_unique")
