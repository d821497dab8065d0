"""Spelling variants against brute force."""

import random
from collections import Counter

import pytest

from solekey.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counted, ratio=2):
    near = {a: [b for b in counted if b != a and one_edit(a, b)] for a in counted}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counted[b], b), default=None)
        form[a] = best if best is not None and counted[best] >= ratio * counted[a] else None
    out = set()
    for a in counted:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, counted[a], len(near[a]), counted.get(form[a])))
    return out


def grouped(spark, counted, **more):
    frame = spark.createDataFrame(list(counted.items()), "word string, n long")
    found = spelling.group_variants(frame, **more)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    return word[:i] + ("" if kind == 1 else rng.choice(letters)) + word[i + 1 :]


@pytest.mark.parametrize("letters", ["ab", "abcdefgé", "abcdefghijklmnopqrstuvwxyzàéüß🙂"])
def test_same_as_brute_force(spark, letters):
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(250)]
    for _ in range(450):
        words.append(edited(rng, rng.choice(words), letters))
    counted = {w: rng.randint(1, 2 ** rng.randint(0, 9)) for w in words if w}
    assert grouped(spark, counted) == brute(counted)
    assert grouped(spark, counted, ratio=3) == brute(counted, 3)


def test_every_near_pair_shares_a_signature():
    rng = random.Random(8)
    for letters in ("aab", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(300):
            a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
            b = edited(rng, a, letters)
            if a == b:
                continue
            keys = list(spelling.signatures([a, b], {ord(c): i for i, c in enumerate(letters[:2])}))
            of = lambda role, k: {(int(x[k])) for r, x in keys if r == role}  # noqa: B023, E731
            if len(a) == len(b):
                assert of(0, 0) & of(0, 1)
            else:
                assert of(1, int(len(a) < len(b))) & of(2, int(len(a) > len(b)))


def test_long_chains_and_ties(spark):
    chain = {"a" * 5 + "b" * i: 2**i for i in range(30)}
    assert grouped(spark, chain) == brute(chain)
    assert {r[2] for r in grouped(spark, chain)} == {"a" * 5 + "b" * 29}
    ties = {"lampe": 1, "lamp": 9, "lamps": 9, "zampe": 9, "dampe": 9}
    assert grouped(spark, ties) == brute(ties)
    huge = {"x" * 50_000: 4, "x" * 50_001: 9, "x" * 49_999 + "y": 1}
    assert grouped(spark, huge) == brute(huge)


def test_runs_and_odd_rows(spark):
    texts = [None, "", "Été ÀB1cd x_y", "a-B c'D", "ça÷va", "日本 abc", "AB" * 40_000]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)] + [(1, "Ab", "w", 1)] * 2, "doc_id long, text string, run string, n int")
    found = Counter((r.doc_id, r.run) for r in spelling.runs(docs).collect())
    expected = Counter([(2, "Été".replace("É", "É")), (2, "Àb"), (2, "cd"), (2, "x"), (2, "y"), (3, "a"), (3, "b"), (3, "c"), (3, "d"),
                        (4, "ça÷va"), (5, "abc"), (6, "ab" * 40_000), (1, "ab"), (1, "ab")])
    assert found == expected
    words = spelling.runs(docs).withColumnRenamed("run", "word")
    assert [tuple(r) for r in spelling.count_words(words, 1, 2).collect()] == [("ab", 2)]
    empty = spelling.count_words(words.limit(0))
    assert spelling.group_variants(empty).count() == 0
    holes = spark.createDataFrame([(None, 3), ("lamp", 3)], "word string, n long")
    assert [tuple(r) for r in spelling.group_variants(holes).collect()] == [("lamp", None, "lamp", 3, 0, None)]
