"""Line dedup with two Bloom filters, so that only suspected repeats are shuffled."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import BROADCAST_ROWS, doc_text, map_batches
from solekey.session import durable

MIN_CHARS = 40
MIN_DOCS = 5

# Positions a line takes in each filter.
PROBES = 3

# Bits for every possible key; a key has MIN_CHARS code points at least, few lines have so few.
BITS_PER_KEY = 32

# The filters' size: what is sent to all tasks is 2 x 32 MB at most, whatever the input. Fuller
# filters suspect more lines, which are all confirmed exactly.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28

# Bits of a piece of the filters that is merged as one row.
PIECE_BITS = 1 << 16


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends (``\\x20``, ``\\x09`` to ``\\x0D``), A-Z lower-cased."""
    return line.strip().lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key in UTF-8 has so many code points."""
    return len(key) >= min_chars and (
        len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars
    )


def keys_of(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and each one's key where that is long enough to be judged."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    found = (line_key(x) for x in lines)
    return lines, [k if long_enough(k, min_chars) else None for k in found]


def positions(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Where a 64-bit hash stands in the filters: one row for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(n_bits - 1) for i in range(PROBES)])


def _hashes(batch: pa.RecordBatch, min_chars: int) -> np.ndarray:
    """The hashes of a batch's keys; each document brings a key once."""
    found: list[int] = []
    for text in batch.column("text").to_pylist():
        found += [xxhash.xxh64_intdigest(k) for k in {k for k in keys_of(text, min_chars)[1] if k is not None}]
    return np.array(found, np.uint64)


def _pieces(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Filter pieces with the bits at sorted positions ``once`` and ``twice`` set."""
    rows: list[tuple] = []
    for piece in np.unique(once // PIECE_BITS).tolist():
        packed = []
        for at in (once, twice):
            low, high = np.searchsorted(at, [piece * PIECE_BITS, (piece + 1) * PIECE_BITS])
            bits = np.zeros(PIECE_BITS, np.uint8)
            bits[at[low:high] - piece * PIECE_BITS] = 1
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        rows.append((piece, *packed))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["piece", "once", "twice"])


def bloom_filters(docs: DataFrame, n_bits: int, min_chars: int = MIN_CHARS) -> tuple[bytes, bytes]:
    """The bits of keys seen once or more, and of those seen twice or more.

    A task sets bits for its own documents and sends compressed pieces. When pieces meet, what
    both saw once is seen twice. The merged filters have a fixed size and go to the driver.
    """

    def build(batches):
        taken = [np.empty(0, np.int64)]
        for batch in batches:
            taken.append(positions(_hashes(batch, min_chars), n_bits).astype(np.int64).T)
        flat = np.concatenate([x.ravel() for x in taken])
        where, count = np.unique(flat, return_counts=True)
        yield from _pieces(where, where[count > 1])

    def merge(batches):
        now, once, twice = None, None, None
        for batch in batches:
            for piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "once", "twice"))):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if piece != now:
                    if now is not None:
                        yield _row(now, once, twice)
                    now, once, twice = piece, a, b
                else:
                    once, twice = once | a, twice | b | (once & a)
        if now is not None:
            yield _row(now, once, twice)

    def _row(piece, once, twice):
        return pa.RecordBatch.from_arrays(
            [pa.array([piece]), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], ["piece", "once", "twice"]
        )

    schema = "piece long, once binary, twice binary"
    built = map_batches(doc_text(docs), build, schema)
    merged = map_batches(built.repartition("piece").sortWithinPartitions("piece"), merge, schema)
    filters = bytearray(n_bits // 8), bytearray(n_bits // 8)
    size = PIECE_BITS // 8
    for row in merged.toLocalIterator():
        for bits, piece in zip(filters, (row["once"], row["twice"])):
            bits[row["piece"] * size : (row["piece"] + 1) * size] = piece
    return bytes(filters[0]), bytes(filters[1])


def _contained(bits: np.ndarray, keys: list[bytes], n_bits: int) -> np.ndarray:
    """Which keys a filter may hold."""
    at = positions(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64), n_bits)
    return ((bits[at >> np.uint64(3)] << (at & np.uint64(7)).astype(np.uint8)) & 128).all(0)


def suspects(docs: DataFrame, twice, n_bits: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """``digest, doc_id`` of every key that the second filter has seen twice; each once a row."""

    def run(batches):
        bits = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            keys, owners = [], []
            ids = batch.column("doc_id")
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {k for k in keys_of(text, min_chars)[1] if k is not None}
                keys += own
                owners += [i] * len(own)
            if not keys:
                continue
            seen = np.flatnonzero(_contained(bits, keys, n_bits))
            if len(seen):
                digests = pa.array([hashlib.sha256(keys[i]).digest() for i in seen.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, ids.take(pa.array(np.array(owners)[seen]))], ["digest", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_text(docs), run, f"digest binary, doc_id {kind}")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, *carry: str) -> DataFrame:
    """``doc_id, kept_text, n_lines, n_dropped`` (and the columns of ``carry``) for every row.

    A text is split at ``\\n``; null and empty texts are one empty line. Lines whose key
    (``line_key``) has ``min_chars`` code points and is held by at least ``min_docs`` documents
    are dropped everywhere but in the largest ``doc_id`` holding it, where all of them stay.
    Rows with the same ``doc_id`` count as one document; those without any count as one document
    together, which never is the largest. Repeated rows each give a row. An empty table gives an
    empty result; other columns are ignored unless carried.

    The filters leave out lines seen in one document; all others are confirmed by their SHA-256
    and the count of distinct documents. A line that very many documents hold is counted by
    partial sums. The repeated lines, digests with their keepers, are counted; up to
    ``BROADCAST_ROWS`` of them go to all tasks, and no text is shuffled. With more, documents
    are joined with the lines they lose by a plain sort-merge join, which Spark splits.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    n_bits = 1 << max(0, (chars * BITS_PER_KEY // (2 * min_chars)).bit_length())
    n_bits = min(max(n_bits, LEAST_BITS), MOST_BITS)
    twice = spark.sparkContext.broadcast(bloom_filters(docs, n_bits, min_chars)[1])
    seen = durable(suspects(docs, twice, n_bits, min_chars))
    # Written, so that it meets the suspects in a join of two exchanges, which Spark can split.
    repeated = durable(
        seen.distinct()
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.max("doc_id").alias("keeper"),
        )
        .where(F.col("n_docs") >= min_docs)
        .select("digest", "keeper")
    )
    own = doc_text(docs, *carry)
    if repeated.count() <= BROADCAST_ROWS:
        keepers = {bytes(r.digest): r.keeper for r in repeated.collect()}
        known = spark.sparkContext.broadcast(keepers)

        def gone_from(batch, lists_of_keys):
            """For each text the keys that it loses."""
            keepers = known.value
            if not keepers:
                return [()] * len(lists_of_keys)
            bits, out = np.frombuffer(twice.value, np.uint8), []
            for doc_id, keys in zip(batch.column("doc_id").to_pylist(), lists_of_keys):
                keys = list({k for k in keys if k is not None})
                if keys:
                    keys = [keys[i] for i in np.flatnonzero(_contained(bits, keys, n_bits)).tolist()]
                digests = ((k, hashlib.sha256(k).digest()) for k in keys)
                out.append({k for k, d in digests if d in keepers and keepers[d] != doc_id})
            return out

    else:
        dropped = (
            seen.join(repeated, "digest")
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias("__owner"))
            .agg(F.collect_set("digest").alias("__digests"))
        )
        own = own.join(dropped, F.col("doc_id").eqNullSafe(F.col("__owner")), "left").drop("__owner")

        def gone_from(batch, lists_of_keys):
            out = []
            for digests, keys in zip(batch.column("__digests").to_pylist(), lists_of_keys):
                gone = set(digests or ())
                out.append({k for k in keys if k and hashlib.sha256(k).digest() in gone} if gone else ())
            return out

    def apply(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            cut = [keys_of(text, min_chars) for text in batch.column("text").to_pylist()]
            for (lines, keys), gone in zip(cut, gone_from(batch, [keys for _, keys in cut])):
                stay = [x for x, k in zip(lines, keys) if not (gone and k in gone)]
                kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            new = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *new, *(batch.column(c) for c in carry)],
                ["doc_id", "kept_text", "n_lines", "n_dropped", *carry],
            )

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(own, apply, f"doc_id {kind}, kept_text string, n_lines long, n_dropped long{kinds}")
