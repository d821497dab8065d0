"""Position list indexes in compressed form: for each cluster and chunk of row ids a bitmap or a short list.

A chunk is 32,768 neighbouring row ids, numbered as Spark's bitmap functions number them. Of a
cluster with many rows in a chunk a bitmap of 4 KB is kept, of others the positions, two bytes
each. Clusters of one column don't share rows, so a chunk of an index holds at most 32,768
positions whatever the table: chunks of two indexes are met in one task and intersected there,
and only containers are shuffled, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solekey.session import durable

CHUNK = 32_768

# A list of so many positions is as large as a bitmap.
DENSE = 2_048

CONTAINERS = "cluster_id long, chunk long, n int, bits binary, positions array<short>"


def _containers(keys: dict[str, list], places: list[np.ndarray], dense: int) -> pa.Table:
    """One container for each array of positions."""
    bits, lists = [], []
    for place in places:
        if len(place) >= dense:
            marked = np.zeros(CHUNK, np.uint8)
            marked[place] = 1
            bits.append(np.packbits(marked, bitorder="little").tobytes())
            lists.append(None)
        else:
            bits.append(None)
            lists.append(np.sort(place).astype(np.int16))
    columns = {name: pa.array(values, pa.int64()) for name, values in keys.items()}
    columns["n"] = pa.array([len(p) for p in places], pa.int32())
    columns["bits"] = pa.array(bits, pa.binary())
    columns["positions"] = pa.array(lists, pa.list_(pa.int16()))
    return pa.table(columns)


def _places(batch) -> list[np.ndarray]:
    """The positions of every container of a table or batch."""
    return [
        np.asarray(positions, np.int64) if bits is None else np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
        for bits, positions in zip(batch.column("bits").to_pylist(), batch.column("positions").to_pylist())
    ]


def compress_index(index: DataFrame) -> DataFrame:
    """An index (cluster_id, row_id) as (cluster_id, chunk, n, bits, positions); row ids are distinct."""
    rows = index.select(
        F.col("cluster_id").cast("long"),
        F.bitmap_bucket_number(F.col("row_id").cast("long")).alias("chunk"),
        F.bitmap_bit_position(F.col("row_id").cast("long")).cast("short").alias("position"),
    )
    dense = DENSE
    listed = rows.groupBy("cluster_id", "chunk").agg(F.collect_list("position").alias("positions"))

    def pack(batches):
        for batch in batches:
            keys = {name: batch.column(name).to_pylist() for name in ("cluster_id", "chunk")}
            places = [np.asarray(p, np.int64) for p in batch.column("positions").to_pylist()]
            yield from _containers(keys, places, dense).to_batches()

    return listed.mapInArrow(pack, CONTAINERS)


def intersect_compressed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The compressed index of a combination from those of its parts; empty if it is unique."""

    dense = DENSE

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        labels = []
        for side in (a, b):
            label = np.full(CHUNK, -1)
            for i, place in enumerate(_places(side)):
                label[place] = i
            labels.append(label)
        both = np.flatnonzero((labels[0] >= 0) & (labels[1] >= 0))
        order = np.lexsort((labels[1][both], labels[0][both]))
        both = both[order]
        x, y = labels[0][both], labels[1][both]
        starts = np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)]) if len(both) else np.zeros(0, int)
        ids_a, ids_b = a.column("cluster_id").to_pylist(), b.column("cluster_id").to_pylist()
        chunk = (a if a.num_rows else b).column("chunk")[0].as_py()
        keys = {"a": [ids_a[i] for i in x[starts]], "b": [ids_b[i] for i in y[starts]], "chunk": [chunk] * len(starts)}
        places = np.split(both, starts[1:]) if len(starts) else []
        return _containers(keys, places, dense).append_column("least", pa.array([_row_id(chunk, p).min() for p in places], pa.int64()))

    schema = "a long, b long, chunk long, n int, bits binary, positions array<short>, least long"
    met = durable(first.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(meet, schema))
    clusters = met.groupBy("a", "b").agg(F.sum("n").alias("size"), F.min("least").alias("cluster_id")).where("size > 1")
    return met.join(clusters, ["a", "b"]).select("cluster_id", "chunk", "n", "bits", "positions")


def _row_id(chunk, position):
    """The row id at a place; chunks from 1 on hold the positive ones."""
    return (chunk - 1) * CHUNK + position + 1 if chunk > 0 else chunk * CHUNK - position


def expand_index(compressed: DataFrame) -> DataFrame:
    """(cluster_id, row_id): the rows of a compressed index."""

    def unpack(batches):
        for batch in batches:
            places = _places(batch)
            chunks = batch.column("chunk").to_pylist()
            ids = [_row_id(c, p) for c, p in zip(chunks, places)]
            clusters = np.repeat(np.array(batch.column("cluster_id").to_pylist(), np.int64), [len(p) for p in places])
            rows = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(clusters), pa.array(rows, pa.int64())], ["cluster_id", "row_id"])

    return compressed.mapInArrow(unpack, "cluster_id long, row_id long")


def cluster_sizes(compressed: DataFrame) -> DataFrame:
    """(cluster_id, size), without unpacking."""
    size: Column = F.sum("n").cast("long").alias("size")
    return compressed.groupBy("cluster_id").agg(size)
