"""Position list indexes: for each repeated value, the rows that hold it.

An index is a narrow frame (cluster_id, row_id); a cluster is named by its smallest row
id and clusters of one row are left out. No cluster is ever held in one array or one
task: sizes come from a combined aggregate, and rows are matched to clusters by a join
in which the largest clusters are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solekey.functions.combos import column
from solekey.plans.coded import code_table
from solekey.session import durable

# The largest clusters are broadcast: never more rows than this, whatever the table. Each
# cluster left for the shuffle then holds at most one HOT_CLUSTERS-th of all cells (rows by
# columns), or of all rows where one combination is indexed.
HOT_CLUSTERS = 1_000


def _clusters(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(__keys, size, cluster_id) of the keys that occur more than once."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("row_id").alias("cluster_id"))
    return found.where(F.col("size") > 1).select(*[F.col(k).alias(f"__{k}") for k in keys], "size", "cluster_id")


def _attach(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the cluster_id of their key, for keys that occur more than once; null equals null."""
    clusters = durable(_clusters(rows, keys))  # counted once, read as the hot ones and as all
    same: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    order = [F.desc("size"), "cluster_id", *[f"__{k}" for k in keys]]
    hot = F.broadcast(clusters.orderBy(*order).limit(HOT_CLUSTERS))
    by_broadcast = rows.join(hot, same)
    by_shuffle = rows.join(hot, same, "left_anti").join(clusters, same)
    out = [c for c in rows.columns] + ["cluster_id"]
    return by_broadcast.select(*out).unionByName(by_shuffle.select(*out))


def single_column_pli(df: DataFrame, row_id_col: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, cluster_id, row_id) for every column; row ids must be distinct and fixed.

    The index is written once, so that every column_index() reads it as it is. Nulls of a
    column form one cluster. Use with_row_id() where the table has no key.
    Values are matched by their proven codes, so long texts are not shuffled.
    """
    cols = [c for c in df.columns if c != row_id_col] if cols is None else list(cols)
    table = code_table(df, cols, stats=False)
    depth = max(len(slots) for slots in table.slots)
    keys = [f"k{j}" for j in range(depth)]

    def key(slots: Sequence[int], j: int) -> Column:
        expr = table.exprs[slots[j]] if j < len(slots) else F.lit(None).cast("long")
        return expr.alias(f"k{j}")

    cells = F.array(
        *[F.struct(F.lit(c).alias("col"), *[key(slots, j) for j in range(depth)]) for c, slots in enumerate(table.slots)]
    )
    rows = df.select(column(row_id_col).alias("row_id"), F.explode(cells).alias("cell")).select("row_id", "cell.*")
    name = F.get(F.array(*[F.lit(c) for c in cols]), F.col("col")).alias("column_name")
    return durable(_attach(rows, ["col", *keys]).select(name, "cluster_id", "row_id"))


def column_index(plis: DataFrame, column: str) -> DataFrame:
    """The index (cluster_id, row_id) of one column out of single_column_pli()."""
    return plis.where(F.col("column_name") == column).select("cluster_id", "row_id")


def intersect_pli(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The index of a combination from the indexes of its parts: (cluster_id, row_id).

    Rows in the same cluster of every input stay together. An empty result says that the
    combination is unique.
    """
    joined = first.select("row_id", F.col("cluster_id").alias("c0"))
    for i, other in enumerate(others, start=1):
        joined = joined.join(other.select("row_id", F.col("cluster_id").alias(f"c{i}")), "row_id")
    keys = [f"c{i}" for i in range(len(others) + 1)]
    return _attach(durable(joined), keys).select("cluster_id", "row_id")
