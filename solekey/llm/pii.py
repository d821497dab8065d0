"""Personal data: generators propose overlapping spans, boosted trees and thresholds choose."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.boosting import Boosted
from solekey.llm.frames import doc_text, drawn, map_batches
from solekey.session import durable

KINDS = ("email", "ip", "card", "phone")

# Candidates to learn from at most, and the share of the added ones that must be right.
TRAIN_CANDIDATES = 20_000
PRECISION = 0.95

# Candidates that can't be of their kind which a threshold needs, and the steps of log odds in which
# candidates are counted.
LEAST_EVIDENCE = 20
STEP, MOST_STEP = 0.25, 40

# What is known of a candidate: it is certain, it can't be of its kind, or neither.
SURE, NOT, OPEN = "sure", "not", "open"

CONTEXT = 24

# The forms that always count. Local parts are found from the sign leftwards, and
# numbers from their first digit, so that long runs of letters or digits take one look each.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider forms that may be personal data, and words that speak for each kind.
GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00|\+)?\(?[0-9]{1,4}\)?(?:[\x20./-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])")),
)
# How the parts of an address may be joined.
AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\sat\s)\s?")
DOT = re.compile(r"\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?")
SENTENCE = re.compile(r"\sat\s[^.]*(?:\s\.|\.\s)")
# What any wide form holds; texts without are not searched.
HINT = re.compile(r"[0-9@]|\(at\)|\[at\]|\sat\s|::", re.I)
CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "ruf"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _at_most_255(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The certain spans: for each kind leftmost ones that don't overlap, failing ones dropped."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at, free = text.find("@", max(at + 1, free)), max(free, at + 1)
    for m in IP.finditer(text):
        if all(map(_at_most_255, m.groups())):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the wide forms propose; they may overlap one another and the certain ones."""
    if not HINT.search(text):
        return []
    return [(kind, *m.span()) for kind, form in GENERATORS for m in form.finditer(text)]


class Taken:
    """Spans of one kind that don't overlap, by start; overlaps are found by bisection."""

    def __init__(self, spans=()):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def overlapping(self, start: int, end: int):
        """The spans that share a sign with start..end."""
        i = bisect_right(self.ends, start)
        while i < len(self.starts) and self.starts[i] < end:
            yield self.starts[i], self.ends[i]
            i += 1

    def meets(self, start: int, end: int) -> bool:
        return next(self.overlapping(start, end), None) is not None

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def by_kind(spans) -> dict[str, Taken]:
    return {kind: Taken(sorted((a, b) for k, a, b in spans if k == kind)) for kind in KINDS}


def impossible(text: str, kind: str, start: int, end: int, sure: dict[str, Taken]) -> bool:
    """Whether a span can't be of its kind, whatever is said around it.

    It is part of a longer word or number, lies in a certain span of another kind, or breaks a rule
    that all values of its kind keep: check digit, parts of at most 255, 7 to 15 digits, a
    top-level name of letters.
    """
    own = text[start:end]
    if text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum():
        return True
    if any(k != kind and taken.meets(start, end) for k, taken in sure.items()):
        return True
    if kind == "email":
        domain = DOT.split(AT.split(own)[-1])
        return not re.fullmatch("[A-Za-z]{2,24}", domain[-1]) or bool(SENTENCE.search(own))
    if kind == "ip":
        try:
            ipaddress.ip_address(own if ":" in own else ".".join(x.lstrip("0") or "0" for x in re.findall("[0-9]+", own)))
        except ValueError:
            return True
        return False
    digits = "".join(c for c in own if "0" <= c <= "9")
    return not luhn(digits) if kind == "card" else not 7 <= len(digits) <= 15


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Context and format of a span, without what makes a span certain or impossible.

    Left out are the check digit, the number of digits, a leading plus sign, how the parts of an
    address are joined, and signs next to the span, so that a span of another make is rated by what it
    shares with the certain ones.
    """
    own = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    name, domain, groups, marks = "", [], [], ""
    if kind == "email":
        name, *rest = AT.split(own)
        domain = DOT.split(rest[-1]) if rest else []
    else:
        groups = re.findall("[0-9A-Fa-f]+", own)
        marks = own.lstrip("+")
    return [
        float(KINDS.index(kind)),
        float(any(c in before for c in CUES[kind])),
        float(any(c in after for c in CUES[kind])),
        float(any(c in before for k in KINDS if k != kind for c in CUES[k])),
        float(min(len(groups), 3)),
        float(any(c in marks for c in " -./(),:")),
        float("," in marks),
        float("(" in marks),
        float(min(len(domain), 2)),
        float(domain[-1].islower() if domain else 0),
        float(min(len(domain[-1]), 5) if domain else 0),
        float(any(c in name for c in "._-+0123456789")),
        float(min(len(name), 4)),
        float(sum(c.isdigit() for c in before + after)),
        float(before.rstrip()[-1:] in (":", "=")),
    ]


def described(text: str, sure=None) -> list[tuple[tuple[str, int, int], list[float], str]]:
    """Candidates with features and what is known of them.

    A candidate is certain if a certain span of its kind covers half of it.
    """
    proposed = candidates(text)
    sure = by_kind((base_spans(text) if sure is None else sure) if proposed else [])
    rows = []
    for kind, start, end in proposed:
        if any(2 * (min(end, b) - max(start, a)) > end - start for a, b in sure[kind].overlapping(start, end)):
            known = SURE
        else:
            known = NOT if impossible(text, kind, start, end, sure) else OPEN
        rows.append(((kind, start, end), features(text, kind, start, end), known))
    return rows


def chosen(sure, rated, least: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """All spans of a text and whether each is certain, by kind and start.

    Certain spans always stay. Of the open candidates those above their kind's threshold are taken
    from the likeliest on, where nothing of the same kind is taken yet.
    """
    taken, held = [(*x, True) for x in sure], by_kind(sure)
    for kind, start, end, odds in sorted(rated, key=lambda x: -x[3]):
        if odds >= least.get(kind, np.inf) and not held[kind].meets(start, end):
            taken.append((kind, start, end, False))
            held[kind].add(start, end)
    return sorted(taken, key=lambda x: (KINDS.index(x[0]), x[1]))


@dataclass
class Detector:
    """The trees, and for each kind the log odds from which an open candidate counts."""

    trees: Boosted | None = None
    least: dict[str, float] = field(default_factory=dict)

    def rated(self, text: str):
        """The certain spans of a text; its candidates with log odds and what is known of them."""
        sure = base_spans(text)
        rows = described(text, sure) if self.trees is not None else []
        odds = self.trees.odds(np.array([x[1] for x in rows])).tolist() if rows else []
        return sure, [(*span, own, known) for (span, _, known), own in zip(rows, odds)]

    def spans(self, text: str) -> list[tuple[str, int, int, bool]]:
        sure, rated = self.rated(text)
        return chosen(sure, [x[:4] for x in rated if x[4] == OPEN], self.least)


def _trees(docs: DataFrame, most: int) -> Boosted | None:
    """Trees from about ``most`` candidates at most, drawn by a hash of document and place.

    They tell the certain candidates from those that can't be of their kind; of the others nothing
    is known, so they are not learned from.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for (kind, start, _), values, known in described(text or ""):
                    if known != OPEN:
                        rows.append((xxhash.xxh64_intdigest(f"{doc_id}:{start}:{kind}") >> 1, values, known == SURE))
            if rows:
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.bool_())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["draw", "features", "right"])

    # Documents without any wide form are told apart by Spark itself and never reach Python.
    own = doc_text(docs).where(F.col("text").rlike(r"[0-9@]|(?i:\(at\)|\[at\]|\sat\s)|::"))
    share = min(1.0, 4 * most / max(1, docs.count()))
    own = own.where(drawn(F.xxhash64("doc_id", F.lit("pii")), share))
    rows = map_batches(own, run, "draw long, features array<double>, right boolean")
    sample = rows.orderBy("draw").limit(most).collect()
    right = np.array([r.right for r in sample], float)
    if not len(sample) or right.min() == right.max():
        return None
    return Boosted().fit(np.array([r.features for r in sample]), right)


SPAN_TYPE = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]


def _rate(docs: DataFrame, detector: Detector) -> DataFrame:
    """``doc_id, base, wide`` for every row: certain spans, and all candidates with their log odds."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        for batch in batches:
            base, wide = [], []
            for text in batch.column("text").to_pylist():
                sure, rated = shared.value.rated(text or "")
                base.append([dict(zip(("kind", "start", "end"), s)) for s in sure])
                wide.append([dict(zip(("kind", "start", "end", "odds", "known"), x)) for x in rated])
            arrays = [batch.column("doc_id"), pa.array(base, base_type), pa.array(wide, wide_type)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "base", "wide"])

    base_type = pa.list_(pa.struct(SPAN_TYPE))
    wide_type = pa.list_(pa.struct([*SPAN_TYPE, ("odds", pa.float64()), ("known", pa.string())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        doc_text(docs),
        run,
        f"doc_id {kind}, base array<struct<kind:string,start:bigint,end:bigint>>, "
        "wide array<struct<kind:string,start:bigint,end:bigint,odds:double,known:string>>",
    )


def thresholds(rated: DataFrame) -> dict[str, float]:
    """For each kind the least log odds from which open candidates count.

    Candidates that can't be of their kind show how the wrong ones among the open ones are rated;
    how many of those there are is read off the lower half of them. From the threshold on, at
    most ``1 - PRECISION`` of the impossible candidates and, by that measure, of the open ones
    are wrong, and an open one is rated at the odds of ``PRECISION`` or as high as that share of the
    certain ones. A kind with
    fewer than ``LEAST_EVIDENCE`` impossible candidates counts its open ones as wrong too.
    Counts cover all documents; only they, a bounded table, come to the driver.
    """
    step = F.greatest(F.least(F.floor(F.col("t.odds") / STEP), F.lit(MOST_STEP)), F.lit(-MOST_STEP))
    counted = (
        rated.select(F.explode("wide").alias("t"))
        .groupBy("t.kind", "t.known", (step + MOST_STEP).cast("int").alias("step"))
        .count()
        .collect()
    )
    tables = {(kind, known): np.zeros(2 * MOST_STEP + 1) for kind in KINDS for known in (SURE, NOT, OPEN)}
    for kind, known, step, count in counted:
        tables[kind, known][step] = count
    likely = MOST_STEP + int(np.ceil(np.log(PRECISION / (1 - PRECISION)) / STEP))
    least = {}
    for kind in KINDS:
        sure, wrong, other = (tables[kind, known] for known in (SURE, NOT, OPEN))
        if wrong.sum() < LEAST_EVIDENCE:
            wrong = wrong + other
        if not sure.any() or not wrong.any():
            continue
        half = int(np.searchsorted(np.cumsum(wrong), wrong.sum() / 2)) + 1
        passed = np.cumsum(wrong[::-1])[::-1] / wrong.sum()
        false = min(other.sum(), other[:half].sum() * wrong.sum() / wrong[:half].sum()) * passed
        open_above = np.cumsum(other[::-1])[::-1]
        floor = min(int(np.searchsorted(np.cumsum(sure), (1 - PRECISION) * sure.sum())), likely)
        good = np.flatnonzero((passed <= 1 - PRECISION) & (false <= (1 - PRECISION) * open_above))
        good = good[good >= floor]
        if len(good) and good[0] <= np.flatnonzero(sure)[-1]:
            least[kind] = (int(good[0]) - MOST_STEP) * STEP if good[0] else -np.inf
    return least


def _choose(rated: DataFrame, least: dict[str, float]) -> DataFrame:
    """``doc_id, spans`` for every rated row."""

    def run(batches):
        for batch in batches:
            found = []
            for sure, wide in zip(batch.column("base").to_pylist(), batch.column("wide").to_pylist()):
                own = [(x["kind"], x["start"], x["end"], x["odds"]) for x in wide]
                spans = chosen([(s["kind"], s["start"], s["end"]) for s in sure], own, least)
                found.append([dict(zip(("kind", "start", "end", "certain"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, span_type)], ["doc_id", "spans"])

    span_type = pa.list_(pa.struct([*SPAN_TYPE, ("certain", pa.bool_())]))
    kind = rated.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,certain:boolean>>"
    return map_batches(rated.withColumn("wide", F.filter("wide", lambda x: x["known"] == OPEN)), run, schema)


def learn(docs: DataFrame, most: int = TRAIN_CANDIDATES) -> Detector:
    """Trees from a bounded sample of candidates, thresholds from the counts of all candidates."""
    trees = _trees(docs, most)
    return Detector() if trees is None else Detector(trees, thresholds(_rate(docs, Detector(trees))))


def find_personal_data(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``doc_id, spans`` for every row; a span has kind, start, end (code points) and ``certain``.

    Spans are ordered by kind (``KINDS``) and start. Null and empty texts have none, and so has
    nothing an empty table. Repeated rows each give a row, null ids stay, other columns are
    ignored. Every text is searched whole, in one pass without a shuffle. Without a detector one
    is learned from the same rows; its candidates are rated once, written and then chosen from.
    """
    if detector is not None:
        return _choose(_rate(docs, detector), detector.least)
    rated = durable(_rate(docs, Detector(_trees(docs, TRAIN_CANDIDATES))))
    return _choose(rated, thresholds(rated))
