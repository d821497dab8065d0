"""Benchmark decontamination: size-partitioned MinHash containment search, then exact checks.

The shortest items are searched by all their shingles instead of a sketch.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import doc_text, map_batches
from solekey.session import durable

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8

# Hash functions of a sketch. A window that holds 0.8 of a sketched item has a similarity to it of
# 0.19 at least, so all of its minima differ in one case of (1 - 0.19) ** 48, or 4 in 100,000.
SKETCH = 48

# The least size class: items of up to so many shingles are searched in the same windows.
LEAST_CLASS = 8

# Items of up to so many shingles are too small a part of those windows. They form a class of
# their own, in which all shingles of items and documents are compared.
EXACT_SHINGLES, EXACT_CLASS = 4, 1

# Positions of a text sketched at a time.
CHUNK = 4096

# The filter of the items' minima that all tasks get: 64 slots for each, 32 MB at most. A fuller
# filter lets more documents through to the join, never fewer.
SLOTS_PER_VALUE, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 16, 1 << 28

_MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> list[bytes]:
    """All five-word shingles of a text: A-Z lower-cased, words between blanks, joined by one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)]


def shingle_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE_WORDS + 1
    if n < 1:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    return np.array([digest(joined[i:j]) for i, j in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())], np.uint64)


def size_class(n: int) -> int:
    """The power of two, LEAST_CLASS at least, that is no less than n; few shingles have their own class."""
    return EXACT_CLASS if n <= EXACT_SHINGLES else max(LEAST_CLASS, 1 << (n - 1).bit_length())


def block_minima(hashes: np.ndarray, block: int) -> np.ndarray:
    """For each hash function (row) the least value in each block of so many positions."""
    starts = np.arange(0, len(hashes), block)
    found = []
    per = max(block, CHUNK // block * block)
    for at in range(0, len(hashes), per):
        part = hashes[at : at + per]
        found.append(
            np.minimum.reduceat(part[None, :] * _MULTIPLIERS[:, None], np.arange(0, len(part), block), axis=1)
        )
    minima = np.concatenate(found, axis=1)
    assert minima.shape[1] == len(starts)
    return minima


def windows(minima: np.ndarray) -> np.ndarray:
    """Minima of windows of two neighbouring blocks each (a single block is its own window)."""
    return minima if minima.shape[1] < 2 else np.minimum(minima[:, 1:], minima[:, :-1])


def window_minima(hashes: np.ndarray, classes: list[int]):
    """For each class the sketches of windows of twice its size, a class size apart."""
    if not len(hashes):
        return
    size, minima = classes[0], block_minima(hashes, classes[0])
    for wanted in classes:
        while size < wanted:
            if minima.shape[1] % 2:
                minima = np.concatenate([minima, minima[:, -1:]], axis=1)
            minima, size = np.minimum(minima[:, ::2], minima[:, 1::2]), size * 2
        yield wanted, windows(minima)


def _slot(size: int, values: np.ndarray, n_slots: int) -> np.ndarray:
    """Two slots for each value, which differ by size class and hash function (row)."""
    rows = np.arange(values.shape[0], dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
    mixed = (values ^ rows) * np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(n_slots - 1)
    return np.stack([(mixed >> np.uint64(32)) & mask, (mixed ^ (mixed >> np.uint64(17))) & mask])


def sketch_items(items: DataFrame) -> DataFrame:
    """``item_id, item_shingles, size_class, sketch`` of items with at least one shingle.

    The sketch of an item of the exact class is the hashes of all its shingles.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                own = sorted(set(shingles(text)))
                if own:
                    hashed = np.array([xxhash.xxh64_intdigest(x) for x in own], np.uint64)
                    size = size_class(len(own))
                    least = hashed if size == EXACT_CLASS else (hashed[None, :] * _MULTIPLIERS[:, None]).min(1)
                    decoded = [x.decode("utf-8", "surrogatepass") for x in own]
                    rows.append((item, decoded, size, least.view(np.int64).tolist()))
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a, batch.column("item_id").type),
                        pa.array(b, pa.list_(pa.string())),
                        pa.array(c, pa.int64()),
                        pa.array(d, pa.list_(pa.int64())),
                    ],
                    ["item_id", "item_shingles", "size_class", "sketch"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    own = items.select("item_id", F.col("text").cast("string").alias("text"))
    return map_batches(own, run, f"item_id {kind}, item_shingles array<string>, size_class long, sketch array<long>")


def _filter(values: DataFrame, n_slots: int) -> bytes:
    """The slots that the items' minima take, as bits; merged from the tasks' parts."""

    def run(batches):
        bits = np.zeros(n_slots, bool)
        for batch in batches:
            sizes = batch.column("size_class").to_numpy()
            sketches = batch.column("sketch").to_pylist()
            for size in np.unique(sizes):
                own = [sketches[i] for i in np.flatnonzero(sizes == size)]
                if size == EXACT_CLASS:
                    least = np.array([[x for sketch in own for x in sketch]], np.int64)
                else:
                    least = np.array(own, np.int64).reshape(-1, SKETCH).T
                bits[_slot(int(size), least.view(np.uint64), n_slots).ravel()] = True
        for at in np.unique(np.flatnonzero(bits) // LEAST_SLOTS).tolist():
            piece = np.packbits(bits[at * LEAST_SLOTS : (at + 1) * LEAST_SLOTS]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([piece])], ["piece", "bits"])

    merged = np.zeros(n_slots // 8, np.uint8)
    size = LEAST_SLOTS // 8
    for row in map_batches(values.select("size_class", "sketch"), run, "piece long, bits binary").toLocalIterator():
        merged[row["piece"] * size : (row["piece"] + 1) * size] |= np.frombuffer(row["bits"], np.uint8)
    return merged.tobytes()


# Candidates' ids that may be broadcast, each a whole number.
BROADCAST_IDS = 2_000_000


def find_contained(docs: DataFrame, items: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of items found in documents.

    An item is found in a document that holds at least ``min_containment`` of the item's
    distinct five-word shingles. Items are parted by size; a document is sketched in windows
    twice as long as the items of a class, so that a short item inside a long document is still
    a good part of a window. A window that shares a minimum with an item makes a candidate, and
    each candidate is checked exactly, over the document's whole text. Items of up to
    ``EXACT_SHINGLES`` shingles are candidates wherever one of them occurs.

    Null, empty and too short texts (under five words) have no shingles: such an item is never
    found, such a document holds nothing. Repeated rows of either table give repeated results.
    Empty tables give an empty result; columns other than ``doc_id``, ``item_id`` and ``text``
    are ignored. Only a filter of bounded size is broadcast; the items' sketches are joined.
    """
    spark = docs.sparkSession
    known = durable(sketch_items(items).withColumn("item_row", F.monotonically_increasing_id()))
    stats = known.agg(F.count(F.lit(1)), F.collect_set("size_class")).first()
    sketched, exact = sorted(set(stats[1]) - {EXACT_CLASS}), EXACT_CLASS in stats[1]
    n_slots = min(max(1 << (stats[0] * SKETCH * SLOTS_PER_VALUE).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    bits = spark.sparkContext.broadcast(_filter(known, n_slots))

    def run(batches):
        slots = np.frombuffer(bits.value, np.uint8)

        def has(at):
            return (slots[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8)) & 128 > 0

        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own: set = set()
                hashes = shingle_hashes(text)
                searched = window_minima(hashes, sketched) if sketched else ()
                if exact and len(hashes):
                    searched = chain(searched, [(EXACT_CLASS, hashes[None, :])])
                for size, minima in searched:
                    slot = _slot(size, minima, n_slots)
                    near = has(slot[0])
                    if near.any():
                        near[near] = has(slot[1][near])
                        row, _ = np.nonzero(near)
                        own |= set(zip([size] * len(row), row.tolist(), minima[near].view(np.int64).tolist()))
                if own:
                    rows.append(i)
                    hits.append([{"size_class": a, "at": b, "value": c} for a, b, c in sorted(own)])
            if rows:
                ids = batch.column("doc_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hits, hit_type)], ["doc_id", "hits"])

    hit_type = pa.list_(pa.struct([("size_class", pa.int64()), ("at", pa.int64()), ("value", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = map_batches(doc_text(docs), run, f"doc_id {kind}, hits array<struct<size_class:bigint,at:bigint,value:bigint>>")
    hits = hits.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", "h.size_class", F.col("h.at").alias("at"), F.col("h.value").alias("value")
    )
    minima = known.select("item_row", "size_class", F.posexplode("sketch").alias("at", "value"))
    if exact:  # its shingles have no place; a document's are all hits of place 0
        minima = minima.withColumn("at", F.when(F.col("size_class") == EXACT_CLASS, 0).otherwise(F.col("at")))
    pairs = durable(hits.join(minima, ["size_class", "at", "value"]).select("doc_id", "item_row").distinct())
    # Texts are fetched for documents that share a value with an item only; ids are narrow.
    ids = durable(pairs.select(F.col("doc_id").alias("__doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS and docs.schema["doc_id"].dataType.simpleString() in ("int", "bigint")
    own = doc_text(docs).withColumn("doc_row", F.monotonically_increasing_id())
    wanted = own.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left_semi")
    # Written, as rows are numbered anew by another run of the scan.
    wanted = durable(wanted)
    asked = pairs.join(known.select("item_row", "item_id", "item_shingles"), "item_row").withColumnRenamed("doc_id", "__doc_id")
    checked = wanted.join(asked, F.col("doc_id").eqNullSafe(F.col("__doc_id"))).select(
        "doc_row", "doc_id", "text", "item_id", "item_shingles"
    )

    def count(batches):
        last, own = None, set()
        for batch in batches:
            shared, sizes = [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_row", "text", "item_shingles"))
            for row, text, wanted in zip(*columns):
                if row != last:
                    last, own = row, {x.decode("utf-8", "surrogatepass") for x in shingles(text)}
                sizes.append(len(wanted))
                shared.append(sum(x in own for x in wanted))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())],
                ["doc_id", "item_id", "n_item", "n_shared"],
            )

    item_kind = items.schema["item_id"].dataType.simpleString()
    counted = map_batches(checked, count, f"doc_id {kind}, item_id {item_kind}, n_item long, n_shared long")
    share = F.col("n_shared") / F.col("n_item")
    return counted.withColumn("containment", share).where(F.col("n_shared") >= min_containment * F.col("n_item"))


def remove_contaminated(docs: DataFrame, items: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``docs`` without the documents in which an item is found, all others as they are.

    Rows without a ``doc_id`` can't be named by the search and stay.
    """
    found = find_contained(docs, items, min_containment).select(F.col("doc_id").alias("__found_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__found_id"), "left_anti")
