"""Small driver-side results as DataFrames, and row ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from solekey.functions.combos import column
from solekey.session import durable


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame of candidate-sized rows; goes in as Arrow, without Python workers."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [() for _ in struct.fields]
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)


def combination_frame(spark: SparkSession, combos: Sequence[Sequence[int]]) -> DataFrame:
    """Combinations as (cols array<int>), the form the lattice operators work on."""
    return local_frame(spark, [(list(c),) for c in combos], "cols array<int>")


def dense_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id") -> DataFrame:
    """Add the ids 0 .. n-1 in the order of columns that tell all rows apart; nulls come first.

    Only those columns are sorted and written: rows are counted per partition, counts are summed
    up to where each partition begins, and ids are joined to the table. The same table gets the
    same ids, however it is partitioned. Rows that repeat in the columns are an error.
    """
    if not order_by or name in df.columns:
        raise ValueError("order_by must name columns, and the new column must be a new one")
    names = [f"__{name}_{i}" for i in range(len(order_by))]
    keys = df.select(*[column(c).alias(n) for c, n in zip(order_by, names)])
    ordered = durable(keys.orderBy(*names))
    if not ordered.groupBy(*names).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat in {list(order_by)}: no order that could be repeated")
    placed = ordered.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.col("place") - F.shiftleft(F.col("part").cast("long"), 33)
    ids = placed.join(F.broadcast(starts), "part").select(*names, (F.col("start") + within).alias(name))
    same = reduce(lambda a, b: a & b, [column(c).eqNullSafe(F.col(n)) for c, n in zip(order_by, names)])
    return df.join(ids, same).select(*[column(c) for c in df.columns], name)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add distinct row ids and write the frame once, so the ids can never change later."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()))
