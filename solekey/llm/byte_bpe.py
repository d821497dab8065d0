"""Byte-level BPE: texts to token ids and back, by a table of ranks.

A text is cut by a pattern; a cut piece that is a token is that token, any other starts as
its single bytes, and the leftmost of the neighbours whose joint bytes have the least rank
are merged until none have one. Pieces of similar length are rows of one padded matrix: each
round merges one pair in every row, so that all rows get shorter by one column, and rows
without a pair leave. Pairs are looked up by a hash table of ids.

Ranks are token ids. Null texts are empty texts; empty texts have no tokens; every input row
gives one row, repeated or not; empty tables give empty tables.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from solekey.llm.frames import doc_text, map_batches, texts

# Rows of a bucket are at most as long as its width; longer pieces are merged one by one.
WIDTHS = (4, 8, 16, 32, 64)

# Cells of a padded matrix, so that its memory is bounded.
CELLS = 1 << 20

# Pieces whose ids are remembered from batch to batch.
REMEMBERED = 200_000

NONE = np.iinfo(np.int32).max
_EMPTY = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two neighbouring ids make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        ends = np.array(list(pairs), np.int64).reshape(-1, 2)
        keys, ranks = self.key(ends[:, 0], ends[:, 1]), np.array(list(pairs.values()), np.int32)
        at = self.slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == _EMPTY)
            won = free[np.unique(at[free], return_index=True)[1]]  # one key for each free slot
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            left = np.setdiff1d(np.arange(len(keys)), won)
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for pairs without; a negative id stands for no token."""
        found = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self.key(left[todo], right[todo])
        at = self.slot(keys)
        for _ in range(self.probes):
            if not len(todo):
                break
            there = self.keys[at]
            hit = there == keys
            found[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != _EMPTY)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return found


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ...: positions of runs one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


class Vocabulary:
    """The ranks of a file, its pairs, and the pieces met before.

    The ids of remembered piece number i are ``flat[start[i] : start[i] + size[i]]``.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = PairTable(pairs)
        self.pieces = regex.compile(pattern).findall
        # Bytes of every token, one after the other; -1 for numbers that are no token.
        self.token_bytes = np.frombuffer(b"".join(self.ids), np.uint8)
        size = np.array([len(token) for token in self.ids])
        of = np.array(list(self.ids.values()))
        self.token_size = np.full(of.max() + 1, -1)
        self.token_start = np.zeros(of.max() + 1, np.int64)
        self.token_size[of], self.token_start[of] = size, np.cumsum(size) - size
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and where each text's ids begin and end."""
        cut = [self.pieces(text) for text in batch]
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        flat, size = self.encode_pieces([p.encode() for p in new])
        self.known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        ends = np.cumsum([0, *map(len, cut)])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, ends[-1])
        sizes = self.size[at]
        ids = self.flat[ragged(self.start[at], sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])[ends]
        if len(self.known) > REMEMBERED or len(self.flat) > REMEMBERED * WIDTHS[-1]:
            self._forget()
        return ids, offsets

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and how many each token has."""
        known = (ids >= 0) & (ids < len(self.token_size))
        if not known.all() or (self.token_size[ids] < 0).any():
            raise ValueError("an id that the ranks don't hold")
        size = self.token_size[ids]
        return self.token_bytes[ragged(self.token_start[ids], size)], size

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, joined = np.cumsum(length) - length, np.frombuffer(b"".join(pieces), np.uint8)
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int32, len(pieces))
        at = np.flatnonzero(whole >= 0)
        done = [(at, whole[at], np.ones(len(at), np.int64))]  # pieces, their ids, how many each
        shortest = 0
        for width in WIDTHS:
            members = np.flatnonzero((whole < 0) & (length > shortest) & (length <= width))
            shortest = width
            for first in range(0, len(members), CELLS // width):
                rows = members[first : first + CELLS // width]
                tokens = np.full((len(rows), width), -1, np.int32)
                filled = np.arange(width) < length[rows, None]
                tokens[filled] = self.single[joined[ragged(start[rows], length[rows])]]
                done += self._merge_rows(rows, tokens, length[rows])
        for i in np.flatnonzero((whole < 0) & (length > shortest)):
            ids = self._merge_long(self.single[joined[start[i] : start[i] + length[i]]])
            done.append((np.array([i]), ids, np.array([len(ids)])))
        size = np.zeros(len(pieces), np.int64)
        for rows, _, n in done:
            size[rows] = n
        start, flat = np.cumsum(size) - size, np.empty(size.sum(), np.int32)
        for rows, ids, n in done:
            flat[ragged(start[rows], n)] = ids
        return flat, size

    def _merge_rows(self, rows: np.ndarray, tokens: np.ndarray, length: np.ndarray) -> list[tuple]:
        """Merge the leftmost pair of least rank in every row, round by round."""
        out = []
        ranks = self._ranks(tokens)
        while len(rows):
            first = ranks.argmin(axis=1)  # the leftmost of equal ones
            each = np.arange(len(rows))
            least = ranks[each, first]
            done, on = least == NONE, least != NONE
            if done.any():
                left = tokens[done]
                out.append((rows[done], left[left >= 0], length[done]))
                rows, tokens, ranks, first, least = rows[on], tokens[on], ranks[on], first[on], least[on]
                length, each = length[on], np.arange(len(rows))
            length = length - 1
            tokens[each, first] = least
            # All rows lose the token behind their merge: the matrix gets one column narrower.
            kept = np.arange(tokens.shape[1] - 1)
            tokens = np.take_along_axis(tokens, kept + (kept > first[:, None]), axis=1)
            if tokens.shape[1] < 2:
                ranks = np.full((len(rows), 1), NONE, np.int32)
                continue
            kept = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, kept + (kept >= first[:, None]), axis=1)
            for pair in (first - 1, first):
                ok = (pair >= 0) & (pair < ranks.shape[1])
                row, col = each[ok], pair[ok]
                ranks[row, col] = self.pairs.look_up(tokens[row, col], tokens[row, col + 1])
        return out

    def _ranks(self, tokens: np.ndarray) -> np.ndarray:
        return self.pairs.look_up(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(tokens), -1)

    def _merge_long(self, tokens: np.ndarray) -> np.ndarray:
        """One piece of any length. A round makes all merges of the least rank that come before any other.

        They come left to right, until one of them makes a new pair of lower rank; that pair's
        turn is the next round.
        """
        ranks = self.pairs.look_up(tokens[:-1], tokens[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            run = np.cumsum(np.diff(at, prepend=at[0]) != 1)  # overlapping pairs: every other one
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            padded = np.concatenate([[-1], tokens, [-1]])
            made = np.full(len(at), least, np.int32)
            left = np.where(np.diff(at, prepend=-9) == 2, least, padded[at])
            lower = self.pairs.look_up(left, made) < least
            lower |= self.pairs.look_up(made, padded[at + 3]) < least
            if lower.any():
                at = at[: lower.argmax() + 1]
            tokens[at] = least
            tokens = np.delete(tokens, at + 1)
            ranks = np.delete(ranks, at)
            at = at - np.arange(len(at))
            for pair in (at - 1, at):
                pair = pair[(pair >= 0) & (pair < len(ranks))]
                ranks[pair] = self.pairs.look_up(tokens[pair], tokens[pair + 1])
        return tokens


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once in each worker."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, without special tokens.

    ``path`` is a rank file (base64 token, rank) that every worker can read, with a token for
    each of the 256 bytes; ``pattern`` cuts the text. Other columns of ``docs`` are left out.
    """

    def run(batches):
        own = vocabulary(path, pattern)
        for batch in batches:
            ids, ends = own.encode(texts(batch))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_text(docs), run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` (binary): the bytes of the tokens of each row.

    Bytes, as ids need not end where a character does. Null ids are no ids; an id that the
    rank file does not hold is an error.
    """

    def run(batches):
        own = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, size = own.decode(ids)
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(np.concatenate([[0], counts]))]
            decoded = [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return map_batches(tokens.select("doc_id", "ids"), run, f"doc_id {kind}, ids array<int>, decoded binary")
