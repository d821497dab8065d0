"""Byte-level BPE against the tokenizer library and against the plain rule."""

import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entries
from solekey.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULES = (PATH, public_tokenizers.PATTERN)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(rng):
    odd = ["", " ", "\n", "\t \r\n  x", "a\x00b", "\x1c\x1d \x85 ", "don't we'll I'm", "<|endoftext|>", "é", "🙂👩‍👩‍👧", "ﬁ ﷺ"]
    alphabets = ("ab", "the", "abcdefghijklmnopqrstuvwxyz", " \n\t", "!-=", "éüßñ", "漢字かな", "0123 ", "aB3-é🙂 ")
    return odd + ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 5, 17, 63, 64, 65, 66, 130, 900)]


def encoded(own, batch):
    ids, ends = own.encode(batch)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def decoded(own, ids):
    return own.decode(np.array(ids, np.int64))[0].tobytes()


def test_ids_are_those_of_the_library(library):
    own = byte_bpe.Vocabulary(*RULES)
    batch = texts(random.Random(1))
    for _ in range(2):  # the second time out of the memory of pieces
        assert encoded(own, batch) == [library.encode_ordinary(t) for t in batch]
    assert [decoded(own, ids) for ids in encoded(own, batch)] == [t.encode() for t in batch]
    with pytest.raises(ValueError):
        decoded(own, [10**6])


def test_matrix_and_single_row_agree():
    own, rng = byte_bpe.Vocabulary(*RULES), random.Random(2)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randint(2, 64))) for _ in range(400)]
    pieces += [bytes(rng.choice(b"the") for _ in range(rng.randint(2, 64))) for _ in range(400)]
    pieces = [p for p in pieces if p not in own.ids]
    flat, size = own.encode_pieces(pieces)
    for piece, ids in zip(pieces, np.split(flat, np.cumsum(size)[:-1])):
        assert own._merge_long(own.single[np.frombuffer(piece, np.uint8)]).tolist() == ids.tolist()


def plain(ranks, piece):
    """The rule itself: merge the leftmost pair of least rank until none has one."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_in_any_order(tmp_path):
    """A vocabulary whose merges may make a pair of lower rank than their own."""
    rng = random.Random(3)
    for turn in range(10):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(60)}
        order = [bytes([b]) for b in range(256)] + rng.sample(sorted(tokens), len(tokens))
        ranks = {t: i for i, t in enumerate(order)}
        path = tmp_path / f"ranks{turn}"
        path.write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for t, i in ranks.items()))
        own = byte_bpe.Vocabulary(str(path), r"[^ ]+| ")
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) for _ in range(60)]
        assert encoded(own, pieces) == [plain(ranks, p.encode()) for p in pieces]


def test_long_pieces_take_no_quadratic_time():
    own = byte_bpe.Vocabulary(*RULES)
    for text in ("the" * 100_000, "a" * 1_000_001, "aaab" * 100_000, " " * 500_000):
        assert decoded(own, own.encode([text])[0]) == text.encode()


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "a b", 7), (3, "the " * 50_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = byte_bpe.decode(byte_bpe.encode(docs, *RULES), *RULES)
    got = sorted([(r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in found.collect()])
    assert got == [(0, 2, b"a b"), (1, 0, b""), (2, 0, b""), (2, 0, b""), (3, 50_001, b"the " * 50_000)]
    empty = byte_bpe.encode(docs.limit(0), *RULES)
    assert byte_bpe.decode(empty, *RULES).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query_against_the_library(spark, library):
    found = {r.doc_id: r for r in entries.queries()["op13_byte_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode_ordinary(doc.text or "")
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
