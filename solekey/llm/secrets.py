"""Secret scans: certain forms, and tokens that pass a battery of randomness tests."""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import doc_text, map_batches
from solekey.session import durable

KINDS = ("assign", "access", "hex")
MIN_TOKEN = 20

# Share of the tokens taken for random that may not be, for each encoding and class of lengths.
FALSE_DISCOVERIES = 0.1

# Tokens with p values over one half that a class needs to be judged by itself alone.
LEAST_EVIDENCE = 20

# The p value that a token of a class without that evidence needs at least: of tokens under 32 signs,
# then of longer ones. In the source of Python's own library 11% of short letters_digits tokens reach
# it, 1% of base64 and base64_url ones, but 48% of lower-case ones; of longer ones of these 2% at most.
SHORT_LEVEL, LONG_LEVEL = 0.25, 0.05

# Steps of the combined p value in which tokens are counted.
STEPS = 50

# The forms that always count.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_HINT = re.compile(r"pass|secret|token|api", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)

# Alphabets in their order; a token's encoding is the first that has all its signs.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower_digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "letters_digits": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ENCODINGS = tuple(ALPHABETS)
_MEMBERS = {name: frozenset(signs) for name, signs in ALPHABETS.items()}
_PLACES = {name: np.full(128, -1) for name in ENCODINGS}
for _name, _signs in ALPHABETS.items():
    _PLACES[_name][[ord(c) for c in _signs]] = np.arange(len(_signs))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The certain spans by start, then kind: leftmost for each kind, failing ones dropped.

    A run of hexadecimal signs, or of capitals and digits after AKIA, is one match, so its least
    length can stand in the pattern; an assignment's value is measured after the match.
    """
    found = []
    if ASSIGN_HINT.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def encoding(token: str) -> str | None:
    signs = set(token.rstrip("="))
    return next((name for name in ENCODINGS if signs <= _MEMBERS[name]), None)


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """The chance of a standard normal value above z."""
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()])


def _chi_squared_tail(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The chance of a chi-squared value above x with k degrees (Wilson and Hilferty)."""
    return _normal_tail((np.cbrt(x / k) - (1 - 2 / (9 * k))) / np.sqrt(2 / (9 * k)))


def battery(tokens: list[str], name: str) -> np.ndarray:
    """One p value for each token of an encoding: small where a uniform source is unlikely.

    Three tests, joined by Fisher's method: chi-squared of the signs' uniformity over the
    alphabet; the number of runs above and below its middle; the correlation of each sign's
    place in the alphabet with the next one's. All tokens are tested at once.
    """
    size = len(ALPHABETS[name])
    stripped = [t.rstrip("=") for t in tokens]
    lengths = np.array([len(t) for t in stripped])
    places = _PLACES[name][np.frombuffer("".join(stripped).encode("ascii"), np.uint8)]
    token = np.repeat(np.arange(len(tokens)), lengths)
    n = lengths.astype(float)

    counts = np.bincount(token * size + places, minlength=len(tokens) * size).reshape(-1, size)
    uniform = _chi_squared_tail((counts**2).sum(1) * size / n - n, np.full(len(n), size - 1.0))

    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    high = places * 2 >= size
    inside = token[1:] == token[:-1]
    runs = 1 + np.bincount(token[1:][inside & (high[1:] != high[:-1])], minlength=len(tokens))
    above = np.add.reduceat(high.astype(float), first)
    below = n - above
    expected = 1 + 2 * above * below / n
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / np.maximum(n - 1, 1), 1e-9))
    turns = np.where((above == 0) | (below == 0), 1e-6, 2 * _normal_tail(np.abs(runs - expected) / spread))

    centred = places - (size - 1) / 2
    product = np.bincount(token[1:][inside], centred[1:][inside] * centred[:-1][inside], minlength=len(tokens))
    serial = 2 * _normal_tail(np.abs(product) / ((size**2 - 1) / 12 * np.sqrt(n - 1)))

    joint = -2 * sum(np.log(np.clip(p, 1e-12, 1.0)) for p in (uniform, turns, serial))
    half = joint / 2
    return np.exp(-half) * (1 + half + half**2 / 2)


def length_class(n) -> int:
    """Lengths by powers of two: short tokens tell less, so they are judged among themselves."""
    return int(n).bit_length()


def merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together, in order and apart."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidate_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, base, tokens`` for every row: certain spans, and all other long tokens with p values."""

    def run(batches):
        for batch in batches:
            base, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base.append(base_spans(text or ""))
                starts, ends = merged(base[-1])
                for m in TOKEN.finditer(text or ""):
                    at = bisect_right(ends, m.start())
                    if at == len(starts) or starts[at] >= m.end():
                        if name := encoding(m[0]):
                            found.append((i, m.start(), m.end(), name, m[0]))
            tokens = [[] for _ in base]
            for name in ENCODINGS:
                own = [x for x in found if x[3] == name]
                for (i, start, end, _, text), p in zip(own, battery([x[4] for x in own], name)) if own else ():
                    size = length_class(len(text.rstrip("=")))
                    tokens[i].append({"kind": name, "start": start, "end": end, "size": size, "p": float(p)})
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, base_type), pa.array(tokens, token_type)], ["doc_id", "base", "tokens"]
            )

    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    base_type = pa.list_(pa.struct(span))
    token_type = pa.list_(pa.struct([*span, ("size", pa.int32()), ("p", pa.float64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        doc_text(docs),
        run,
        f"doc_id {kind}, base array<struct<kind:string,start:bigint,end:bigint>>, "
        "tokens array<struct<kind:string,start:bigint,end:bigint,size:int,p:double>>",
    )


def level(size: int) -> float:
    """The p value that counts in a class of lengths of which too little is known."""
    return SHORT_LEVEL if size <= length_class(31) else LONG_LEVEL


def _least(counts: np.ndarray, most: float) -> float | None:
    """The least p value above which a share of ``most`` at most is beyond what random tokens make."""
    half, quarter = counts[STEPS // 2 :], counts[-STEPS // 4 :]
    even = min(half.mean(), quarter.mean() + np.sqrt(quarter.sum()) / len(quarter))
    above = np.cumsum(counts[::-1])[::-1]
    beyond = above - even * np.arange(STEPS, 0, -1)
    good = np.flatnonzero(beyond <= most * above)
    return max(int(good[0]), 1) / STEPS if len(good) else None


def thresholds(found: DataFrame, most: float = FALSE_DISCOVERIES) -> dict[tuple[str, int], float]:
    """For each encoding and length class the least p value of a discovery.

    Random tokens have p values spread evenly, others small ones. The even share is read off the
    upper half (or the upper quarter, with one standard error, if that has less); the threshold is
    the least one above which a share of ``most`` at most is beyond what random tokens make there.
    A class with too few tokens in the upper half is judged together with the neighbouring lengths
    of its encoding, then with the whole encoding, then with all tokens, and, if they are too few
    as well or don't tell, by a fixed level for its length, which is the least in each case. So
    a single random token can be found in a table of any size.
    Counts cover all documents; only they, a bounded table, come to the driver.
    """
    counted = (
        found.select(F.explode("tokens").alias("t"))
        .groupBy("t.kind", "t.size", F.least(F.floor(F.col("t.p") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step"))
        .count()
        .collect()
    )
    tables: dict[tuple[str, int], np.ndarray] = {}
    for kind, size, step, count in counted:
        tables.setdefault((kind, size), np.zeros(STEPS))[step] = count
    least = {}
    for (kind, size), counts in tables.items():
        if counts[STEPS // 2 :].sum() >= LEAST_EVIDENCE:
            if (p := _least(counts, most)) is not None:
                least[kind, size] = p
            continue
        near = sum(c for (k, n), c in tables.items() if k == kind and abs(n - size) <= 1)
        pools = (near, sum(c for (k, _), c in tables.items() if k == kind), sum(tables.values()))
        told = (_least(c, most) for c in pools if c[STEPS // 2 :].sum() >= LEAST_EVIDENCE)
        least[kind, size] = max(level(size), next((p for p in told if p is not None), 0.0))
    return least


def find_secrets(docs: DataFrame, most_false: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, spans`` for every row; a span has kind, start, end (code points) and ``certain``.

    Certain spans always stay; other tokens count where their p value reaches the threshold of
    their encoding and length class, and their kind is the encoding with the prefix ``random_``.
    Spans are ordered by start, then kind. Null and empty texts have none; repeated rows each
    give a row; null ids stay; an empty table gives an empty result; other columns are ignored.
    Texts are read once; what was found is written and then filtered.
    """
    found = durable(candidate_tokens(docs))
    least = thresholds(found, most_false)
    token = "array<struct<kind:string,start:bigint,end:bigint,certain:boolean>>"

    def accepted(t):
        rule = F.lit(False)
        for (kind, size), p in sorted(least.items()):
            rule = rule | ((t["kind"] == kind) & (t["size"] == size) & (t["p"] >= p))
        return rule

    sure = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"], F.lit(True).alias("certain")))
    more = F.transform(
        F.filter("tokens", accepted),
        lambda t: F.struct(F.concat(F.lit("random_"), t["kind"]).alias("kind"), t["start"], t["end"], F.lit(False).alias("certain")),
    )
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def placed(s):
        rank = F.coalesce(F.element_at(order, s["kind"]), F.lit(len(KINDS)))
        return F.struct(s["start"], rank.alias("rank"), s["kind"], s["end"], s["certain"])

    ordered = F.transform(
        F.array_sort(F.transform(F.concat(sure.cast(token), more.cast(token)), placed)),
        lambda s: F.struct(s["kind"], s["start"], s["end"], s["certain"]),
    )
    return found.select("doc_id", ordered.cast(token).alias("spans"))
