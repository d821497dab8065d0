"""Spelling variants: words one edit apart, each led to its most frequent neighbour and on to a root.

A word is the set of its letters, the second of a kind being a member of its own: a binary
vector with as many ones as letters. One replaced letter changes two members, one inserted
or deleted letter one. Members are dealt into a few parts; of words that differ in at most
two members all parts but two are equal, of those that differ in one all but one. So each
word gets a signature for every choice of parts to leave out, together with the length at
which the two words can meet and with its first or its second half, of which one edit leaves
one as it is. Only words with an equal signature are compared; the signatures miss no pair.
An equi-join brings the words together, the edit distance decides.

Null words and words that nobody counted have no place in the result; repeated words must be
summed before. Empty tables give empty tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import doc_text, map_batches
from solekey.session import durable

# Parts of which two, or one, are left out.
PARTS_OF_TWO = 4
PARTS_OF_ONE = 2

# Letters placed by how often they occur; rarer ones are placed by their code point.
RANKED_LETTERS = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def lower_ascii(run: Column) -> Column:
    return F.when(run.rlike("[A-Z]"), F.translate(run, _UPPER, _LOWER)).otherwise(run)


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: every run of letters of every whole text, A-Z lower-cased; null texts have none."""
    found = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")
    return doc_text(docs).select("doc_id", found).select("doc_id", lower_ascii(F.col("run")).alias("run"))


def count_words(words: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n``: words of at least so many code points that occur at least so often."""
    long = words.where(F.length("word") >= min_chars)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def group_variants(counted: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``counted`` (word, n; words distinct).

    Two words are near if one inserted, deleted or replaced code point tells them apart. The
    form of a word is its most frequent near word (the smallest of equals in code-point order) if that has at
    least ``ratio`` times the count; the root is where the forms lead, or the word itself.
    """
    counted = durable(counted.select("word", "n").where("word IS NOT NULL"))
    pairs = near_pairs(counted)
    both = pairs.unionByName(
        pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    )
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best")
    )
    strong = -F.col("best.less") >= ratio * F.col("n")
    formed = counted.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.b")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    formed = durable(formed)
    ends = _ends(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def near_pairs(counted: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words one edit apart, once."""
    signed = _signed(counted)
    a, b = (signed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("role", "word", "n")]) for x in "ab")
    roles = (F.col("role_a") == 0) & (F.col("role_b") == 0) & (F.col("word_a") < F.col("word_b"))
    roles = roles | (F.col("role_a") == 1) & (F.col("role_b") == 2)
    met = a.join(b, "key").where(roles & (F.levenshtein("word_a", "word_b", 1) == 1))
    names = {"word_a": "a", "n_a": "n_a", "word_b": "b", "n_b": "n_b"}
    return durable(met.select(*[F.col(old).alias(new) for old, new in names.items()]).dropDuplicates(["a", "b"]))


def _signed(counted: DataFrame) -> DataFrame:
    """``role, key, word, n``: a row for each signature; role 0 meets 0, and 1 (longer) meets 2 (shorter)."""
    letters = counted.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    ranked = letters.orderBy(F.desc("count"), "letter").limit(RANKED_LETTERS).select("letter").collect()
    place = {ord(r.letter): i for i, r in enumerate(ranked) if r.letter}

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for role, keys in signatures(words, place):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), role, np.int8)), pa.array(keys), *batch.columns],
                    ["role", "key", *batch.schema.names],
                )

    return map_batches(counted, run, "role byte, key long, word string, n long")


def signatures(words: list[str], place: dict[int, int]):
    """(role, a key for each word) for every choice of parts to leave out and each half that is kept."""
    length = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    whose = np.repeat(np.arange(len(words)), length)
    from_start = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    from_end = np.repeat(length, length) - 1 - from_start
    order = np.lexsort((points, whose))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(points[order]) != 0) | (np.diff(whose[order]) != 0)
    at = np.arange(len(order))
    nth = np.empty(len(order), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))  # 0 for the first of its kind in the word
    different, back = np.unique(points, return_inverse=True)
    spot = np.array([place.get(int(p), int(p)) for p in different], np.int64)[back] + nth

    def hashed(more, salt):
        return _mixed((points.astype(np.uint64) << np.uint64(32)) + (more.astype(np.uint64) << np.uint64(2)) + np.uint64(salt))

    def total(values, where):
        out = np.zeros(len(words), np.uint64)
        np.add.at(out, whose[where], values[where])
        return out

    members, heads, tails = hashed(nth, 1), hashed(from_start, 2), hashed(from_end, 3)

    def parts(n):
        return [total(members, spot % n == i) for i in range(n)]

    def halves(size):
        """Hashes of the first half of ``size`` letters and of the last ones that make up the rest."""
        half = size // 2
        return total(heads, from_start < np.repeat(half, length)), total(tails, from_end < np.repeat(size - half, length))

    def keys(left_out, all_parts, meet, kept, choice):
        rest = sum(p for i, p in enumerate(all_parts) if i not in left_out)
        for side, half in enumerate(kept):
            mark = _mixed((meet.astype(np.uint64) << np.uint64(16)) + np.uint64(choice << 1 | side))
            yield _mixed(_mixed(half + mark) + rest).view(np.int64)

    none = np.zeros(len(words), np.uint64)
    two, one = [none, *parts(PARTS_OF_TWO)], [none, *parts(PARTS_OF_ONE)]
    same, longer = halves(length), halves(length - 1)
    for choice, (i, j) in enumerate(combinations(range(1, PARTS_OF_TWO + 1), 2)):
        for key in keys((i, j), two, length, same, choice):
            yield 0, key
    for i in range(1, PARTS_OF_ONE + 1):
        for key in keys((i,), one, length, longer, 1 << 10 | i):
            yield 1, key
        for key in keys((i,), one, length + 1, same, 1 << 10 | i):
            yield 2, key


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ends(links: DataFrame) -> DataFrame:
    """``word, root``: where the forms lead. Counts grow along the way, so there are no circles.

    Every round doubles the steps taken; as counts double with each step, there are at most
    six rounds.
    """
    links = durable(links)
    while True:
        onward = links.select(F.col("word").alias("form"), F.col("form").alias("next"))
        step = links.join(onward, "form", "left").select(
            "word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")
        )
        step = durable(step)
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            return links.withColumnRenamed("form", "root")
