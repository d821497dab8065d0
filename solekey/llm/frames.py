"""Small helpers the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a batch handed to Python. Texts may be very long, so a batch must not hold many.
BATCH_ROWS = 1000

# A frame with at most this many counted, narrow rows may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """Run ``function(batches)`` on each partition's Arrow batches, few rows at a time.

    The number of rows is a setting of the session, which stays: it counts when the frame is run.
    Only memory depends on it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, so that other columns can't clash with its own."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def held_out(doc_id) -> F.col:
    """Rows that no model may learn from: crc32 of the id's text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def drawn(hashed, share: float):
    """Rows whose 64-bit hash falls into a share of all hashes, however small the share."""
    return F.shiftrightunsigned(hashed, 11) / float(2**53) < share
