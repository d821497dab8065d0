"""SimHash near-duplicates: fingerprints, pigeonring filtering, connected groups."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solekey.llm.components import components
from solekey.llm.frames import doc_text, map_batches
from solekey.session import durable

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42

# Shingles whose bits are counted at a time.
CHUNK = 1 << 16

# In buckets up to this size all pairs are compared at once; in larger ones a search from
# member to member finds the groups.
SMALL_BUCKET = 8

# Above this size a bucket is searched by flipping bits, which takes time in proportion to its size.
WIDE_BUCKET = 10_000


def fingerprint(text: str, n_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text: a bit is 1 if more than half of all shingle hashes have it.

    A-Z are lower-cased; words are runs without blanks (``\\x20``, ``\\x09`` to ``\\x0D``), which
    is how ``bytes.split`` divides. With fewer words the whole sequence is the only shingle;
    with none the fingerprint is 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - n_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(n_words, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(n, at + CHUNK)].tolist(), stops[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[i:j], HASH_SEED) for i, j in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, n_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint`` (signed 64-bit) of every row's whole text; null texts are empty."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(x or "", n_words) for x in batch.column("text").to_pylist()]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "fingerprint"])

    return map_batches(doc_text(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """Shift and width of the segments on the ring: two more than bits may differ."""
    count = max_bits + 2
    cuts = [64 * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def keys(fp: Column, max_bits: int) -> Column:
    """One key for each two segments.

    Of ``max_bits + 2`` segments at least two are equal where at most ``max_bits`` bits differ,
    so every pair meets under a key. A chain on the ring starts at an equal segment and, as its
    budget after two segments is below 2, goes on with at most one difference; the second equal
    segment is its next one or lies behind one difference.
    """
    parts = [F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in segments(max_bits)]
    return F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.shiftleft(parts[i], 32).bitwiseOR(parts[j]).alias("key"))
            for kind, (i, j) in enumerate(combinations(range(max_bits + 2), 2))
        ]
    )


def ring_passes(differences: np.ndarray, max_bits: int) -> np.ndarray:
    """Which differences of fingerprints have a chain around the ring within its budgets.

    Some start must exist from which the first l segments together differ in at most
    l * max_bits / count bits, for every l up to count.
    """
    parts = segments(max_bits)
    count = len(parts)
    each = [
        np.bitwise_count((differences >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int16)
        for low, width in parts
    ]
    passes = np.zeros(len(differences), bool)
    for start in range(count):
        held, total = np.ones(len(differences), bool), np.zeros(len(differences), np.int16)
        for length in range(1, count + 1):
            total = total + each[(start + length - 1) % count]
            held &= total * count <= length * max_bits
        passes |= held
    return passes


def within(differences: np.ndarray, max_bits: int) -> np.ndarray:
    """The full Hamming check, run only on what the ring lets through."""
    near = ring_passes(differences, max_bits)
    near[near] = np.bitwise_count(differences[near]) <= max_bits
    return near


def _small_buckets(values: np.ndarray, bucket: np.ndarray, max_bits: int):
    for step in range(1, SMALL_BUCKET):
        together = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(together):
            return
        linked = together[within(values[together] ^ values[together + step], max_bits)]
        yield values[linked], values[linked + step]


def _bucket_tree(values: np.ndarray, max_bits: int):
    """Links that join the members of one bucket as far as differences within it do."""
    if len(values) > WIDE_BUCKET:
        yield from _bucket_by_flips(values, max_bits)
        return
    open_, ends, froms = values.copy(), [], []
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            at = front.pop()
            near = within(open_ ^ at, max_bits)
            found = open_[near]
            front.extend(found)
            ends.append(found)
            froms.append(np.full(len(found), at, np.uint64))
            open_ = open_[~near]
    if ends:
        yield np.concatenate(froms), np.concatenate(ends)


def _bucket_by_flips(values: np.ndarray, max_bits: int):
    """The same for a large bucket: look up each value with up to ``max_bits`` bits flipped."""
    values = np.sort(values)
    root = np.arange(len(values))
    for size in range(1, max_bits + 1):
        for bits in combinations(range(64), size):
            flipped = values ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(values, flipped), len(values) - 1)
            here = np.flatnonzero((values[at] == flipped) & (at < np.arange(len(values))))
            new = here[root[here] != root[at[here]]]  # a link already implied isn't sent again
            root[new] = np.minimum(root[new], root[at[new]])
            if len(new):
                yield values[new], values[at[new]]


def bucket_links(batches, max_bits: int):
    """Links within buckets of rows sorted by ``kind, key``; a bucket may span batches."""
    names = ["a", "b"]

    def links(kind, key, value):
        new = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate(([0], new, [len(value)]))
        sizes = np.diff(bounds)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
        yield from _small_buckets(value[small], bucket[small], max_bits)
        for i in np.flatnonzero(sizes > SMALL_BUCKET):
            yield from _bucket_tree(value[bounds[i] : bounds[i + 1]], max_bits)

    held: list[tuple] = []
    for batch in batches:
        part = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "fingerprint"))
        if not len(part[0]):
            continue
        if held and (held[-1][0][-1], held[-1][1][-1]) == (part[0][-1], part[1][-1]):
            held.append(part)
            continue
        held.append(part)
        kind, key, value = (np.concatenate(x) for x in zip(*held))
        last = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
        cut = last[-1] + 1 if len(last) else 0
        for a, b in links(kind[:cut], key[:cut], value[:cut].view(np.uint64)) if cut else ():
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)
        held = [(kind[cut:], key[cut:], value[cut:])]
    if held:
        kind, key, value = (np.concatenate(x) for x in zip(*held))
        for a, b in links(kind, key, value.view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)


def links(values: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints within ``max_bits`` of each other.

    Fingerprints meet under keys of two equal segments, are pruned by the ring and checked in
    full. A bucket sends a tree over what it has linked, never all its pairs.
    """
    keyed = values.select("fingerprint", F.explode(keys(F.col("fingerprint"), max_bits)).alias("k")).select(
        "k.kind", "k.key", "fingerprint"
    )
    dealt = keyed.repartition("kind", "key").sortWithinPartitions("kind", "key")
    return map_batches(dealt, lambda batches: bucket_links(batches, max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, n_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Rows link where their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is
    the smallest ``doc_id`` reachable. Equal fingerprints are one node, so copies make no pairs.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay, each
    with the same result. A null ``doc_id`` never names a group that has another; an empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    marked = durable(fingerprints(docs, n_words))
    nodes = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, max_bits)).select(F.col("node").alias("fingerprint"), "component")
    placed = nodes.join(roots, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(named, "component").select("fingerprint", "component_id")
    return marked.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def simhash_dedup(docs: DataFrame, n_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group: the one whose ``doc_id`` names the group.

    Repeated rows of that document collapse to one. Rows without a ``doc_id`` can't be told
    apart by it and stay as they are.
    """
    chosen = (
        simhash_groups(docs, n_words, max_bits)
        .where("doc_id = component_id")
        .select(F.col("doc_id").alias("__kept_id"))
        .distinct()
    )
    named = docs.where("doc_id IS NOT NULL").join(chosen, F.col("doc_id") == F.col("__kept_id"), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))
