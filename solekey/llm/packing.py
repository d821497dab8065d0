"""Packing of token sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import doc_text, map_batches

# Pieces that wait for a place in one task at a time.
WINDOW = 2048

# Words whose ids a Python worker remembers, from task to task, of plain and of odd texts each; about 28 MB for 200,000 of prose.
CACHE_WORDS = 200_000
# Longer ones are not remembered, nor those not met before; a table of so many marks tells which were.
CACHE_CHARS = 64
MARKS = 1 << 20

# How the tokenizer cuts texts without odd signs into pieces, whose ids don't depend
# on what stands around them. It lower-cases and drops white space itself.
LETTERS, NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9"
PIECES = re.compile(rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
# Texts with other scripts, combining or control signs, rare spaces, or strings of special tokens
# are only cut at plain blanks.
ODD_SIGN = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0²³¹¼½¾İ\u0250-\U0010ffff]")
ODD = re.compile(rf"<\||{ODD_SIGN.pattern}")
BLANKS = re.compile("[ \t\n\r\f\v]+")


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most: tokens, pieces, and tokens that bear loss."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096

    def sizes(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.int64)


class Known(dict):
    """Ids of words, remembered from the second time a word is met: most words of a corpus occur once."""

    def __init__(self, find):
        self.find, self.met = find, bytearray(MARKS)

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            mark = hash(word) % MARKS
            if self.met[mark]:
                self[word] = ids
            else:
                self.met[mark] = 1
        return ids


class Tokens:
    """Ids of texts by a file of the tokenizers library, remembered for each word."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.plain, self.odd = Known(self._plain), Known(self._odd)
        self.spelled = self._spelling()
        self.word = re.compile(f"[{''.join(map(re.escape, self.spelled))}]+" if self.spelled else r"(?!)")
        self.letters = str.maketrans(self.spelled)
        self.tokenize = self.tokenizer.model.tokenize

    def _spelling(self) -> dict[str, str]:
        """How the tokenizer hands single letters to its model, of those that it leaves as they are."""
        normal, cut, out = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, {}
        for c in filter(re.compile(f"[{LETTERS}]").match, map(chr, range(0x250))):
            if (normal is None or normal.normalize_str(c) == c) and cut is not None:
                if len(pieces := cut.pre_tokenize_str(c)) == 1:
                    out[c] = pieces[0][0]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each whole text's ids, then the end id, as little-endian unsigned 32-bit numbers."""
        plain, odd, end = self.plain.__getitem__, self.odd.__getitem__, self.end
        return [
            b"".join(map(odd, BLANKS.split(text))) + end if is_odd(text) else b"".join(map(plain, text.lower().split())) + end
            for text in texts
        ]

    def _plain(self, word: str) -> bytes:
        """A lower-cased word of a plain text: the ids of its pieces.

        Those of plain letters go straight to the model, which is much cheaper than an encoding with its offsets.
        """
        pieces = PIECES.findall(word)
        if len(pieces) != 1:
            return b"".join(map(self.plain.__getitem__, pieces))
        if self.word.fullmatch(word):
            return _bytes([t.id for t in self.tokenize(word if word.isascii() else word.translate(self.letters))])
        return _bytes(self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False).ids)

    def _odd(self, word: str) -> bytes:
        if not is_odd(word):
            return self.plain[word.lower()]
        (found,) = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)
        return _bytes(found.ids)


def is_odd(text: str) -> bool:
    return ODD_SIGN.search(text) is not None or "<|" in text


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


_WORKER: dict[tuple, Tokens] = {}


def tokens_of(path: str, end_id: int | None) -> Tokens:
    """The worker's own tokenizer, with what it remembers."""
    if (path, end_id) not in _WORKER:
        _WORKER[path, end_id] = Tokens(path, end_id)
    return _WORKER[path, end_id]


def pack(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Fill bins one after the other with rows of ``sizes`` (n x 3), none above ``limits``.

    The next row of a bin is the one, among those that fit, whose sizes (as shares of the
    limits) have the largest dot product with the room left; ties go to the first row. A row
    that alone exceeds a limit gets a bin of its own.
    """
    order = np.argsort(-sizes[:, 0], kind="stable")
    own, limits = sizes[order], limits.astype(np.int64)
    shares, left, columns = own / limits, np.arange(len(own)), np.ascontiguousarray(own.T)
    free = np.ones(len(own), bool)
    bins = []
    while len(left):
        room, chosen = limits.copy(), []
        here = left
        while True:
            here = here[np.logical_and.reduce([own_size[here] <= most for own_size, most in zip(columns, room)])]
            if not len(here):
                break
            best = here[np.argmax(shares[here] @ (room / limits))]
            chosen.append(best)
            room = room - own[best]
            here = here[here != best]
        if not chosen:
            chosen = [left[0]]
        bins.append(order[chosen].tolist())
        free[chosen] = False
        left = left[free[left]]
    return bins


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    limits: Limits = Limits(),
    loss_on_first: bool = False,
    prompt_column: str | None = None,
) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text)``, placed in a sequence.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens``. A
    document's ids are those of its whole text by the tokenizer file, then ``end_id``. It is
    cut where a piece reaches ``limits.tokens`` ids or ``limits.loss_tokens`` of them that bear loss;
    the pieces are packed under all three limits. A piece's first id bears no loss unless
    ``loss_on_first``. ``prompt_column`` says how many of a document's first ids bear none either;
    null is none of them. Without it the limit of loss binds only if it is below that of tokens.

    Null and empty texts are the end id alone (nothing at all without an end id). Repeated rows
    are packed each for itself. An empty table gives an empty result; other columns of ``docs``
    are ignored. A task packs a window of its pieces at a time and carries the bins with most
    room over to the next window, so memory is bounded, nothing is shuffled, and padding is the
    last window's remainder. Sequence ids are unique: the task's number and a count.
    """
    at_most = limits.sizes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = tokens_of(tokenizer, end_id)
        task, made = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []

        def placed(last: bool):
            nonlocal waiting, made
            sizes = np.array([(x[2], 1, x[5]) for x in waiting], np.int64).reshape(-1, 3)
            bins = pack(sizes, at_most)
            left, rows = [], []
            full = 0.995 * limits.tokens
            for k, chosen in enumerate(bins):
                if not last and len(left) < WINDOW // 2 and sizes[chosen, 0].sum() < full:
                    left += chosen
                    continue
                offset = 0
                for i in chosen:
                    x = waiting[i]
                    rows.append((*x[:5], (task << 33) + made, offset, x[5]))
                    offset += x[2]
                made += 1
            waiting = [waiting[i] for i in sorted(left)]
            return rows

        def record(rows):
            columns = list(zip(*rows))
            ids = pa.array(columns[0], id_type[0])
            rest = [pa.array(x, pa.int64()) for x in columns[1:]]
            return pa.RecordBatch.from_arrays([ids, *rest], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
        id_type = []
        for batch in batches:
            id_type[:] = [batch.column("doc_id").type]
            found = tokens.ids([x or "" for x in batch.column("text").to_pylist()])
            prompts = batch.column("prompt_ids").to_pylist() if prompt_column else [0] * len(found)
            for doc_id, ids, prompt in zip(batch.column("doc_id").to_pylist(), found, prompts):
                total, start = len(ids) // 4, 0
                while start < total:
                    bearing = max(start + (not loss_on_first), prompt or 0)
                    end = max(start + 1, min(total, start + limits.tokens, bearing + limits.loss_tokens))
                    piece = ids[4 * start : 4 * end]
                    waiting.append((doc_id, start, end - start, zlib.crc32(piece), total, max(0, end - bearing)))
                    start = end
                if len(waiting) >= WINDOW and (rows := placed(False)):
                    yield record(rows)
        if waiting and (rows := placed(True)):
            yield record(rows)

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "loss_tokens long"
    )
    more = [F.col(prompt_column).cast("long").alias("prompt_ids")] if prompt_column else []
    return map_batches(doc_text(docs, *more), run, schema)
