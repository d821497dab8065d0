"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import doc_text, held_out, map_batches
from solekey.session import durable

# Labelled rows to learn from at most (about so many, drawn by a hash of the id), and terms that
# are weighed on them. Scoring has no such bounds.
TRAIN_ROWS = 20_000
TERMS = 20_000

# Lengths of the pieces of words that may become terms.
PIECE_CHARS = range(4, 9)

# A term needs so many toxic documents, and is counted so often in a text.
MIN_SUPPORT, MOST_COUNTED = 4, 3

# Terms are looked for twice: first those that clean documents hardly hold, then, for the toxic
# documents without any of these, weaker ones that only a number of matches makes suspicious.
# For each: clean documents by toxic ones at most, and the least weight (a log odds ratio).
ROUNDS = ((0.05, 3.0), (1.0, 1.5))

# A word around a term is an exception where it is in so many clean documents, and more of them
# than toxic ones.
MIN_CLEAN = 3

# Insults that count where no label speaks about them, with that prior weight.
SEED_TERMS = "idiot moron stupid scum pathetic worthless loser imbecile bastard dumbass asshole fucker bitch whore".split()
SEED_WEIGHT = 4.0

# Harmless phrases that contain insults.
EXCEPTIONS = "oxymoron|scumble|closer look|scunthorpe|trash can|trash bin|idiot proof".split("|")

# Letters that look like Latin ones, and signs and digits written for letters.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕкмтнв"
    "αεορτυχικνı",
    "aeopcyxijskmthb" "aeoptuxikvi",
)
SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
LOOKALIKE = re.compile("[Ͱ-ԯı]")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, no accents, look-alike letters as Latin ones, digits and signs as letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
        if LOOKALIKE.search(text):
            text = text.translate(LOOKALIKES)
        return "".join(c for c in text if not unicodedata.combining(c)).translate(SUBSTITUTES)
    return text.lower().translate(SUBSTITUTES)


def spaced(folded: str) -> str:
    """The words of a folded text with one blank around each."""
    return f" {' '.join(WORD.findall(folded))} "


def pieces(words) -> set[str]:
    """The pieces of words that may become terms; a blank marks a word's start or end."""
    found = set()
    for word in words:
        padded = f" {word} "
        if 3 < len(word) <= 30:
            found.add(padded)
        for n in PIECE_CHARS:
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    return found


def automaton(entries: dict[str, object]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for text, value in entries.items():
        made.add_word(text, (len(text), value))
    made.make_automaton()
    return made


def _matches(made: ahocorasick.Automaton, folded: str):
    """Start, end and value of every match, overlapping ones too."""
    if not len(made):
        return
    for last, (length, value) in made.iter(folded):
        yield last + 1 - length, last + 1, value


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the line from a text's load to its score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -3.0
    slope: float = 1.0

    def matcher(self):
        """A function from a text to its load: the weights matched, by the root of its length."""
        entries: dict[str, tuple] = {t: (t, w) for t, w in self.weights.items()}
        entries |= {spaced(fold(e)): (None, 0.0) for e in self.exceptions}
        made = automaton(entries)

        def load(text: str) -> float:
            words = spaced(fold(text))
            spans = list(_matches(made, words))
            if not spans:
                return 0.0
            excused = [(a, b) for a, b, (term, _) in spans if term is None]
            # Of the terms in one word only the heaviest counts.
            places: dict[int, tuple] = {}
            for a, b, (term, weight) in spans:
                if term is None or any(x <= a and b <= y for x, y in excused):
                    continue
                word = words.rfind(" ", 0, a + 1)
                if places.get(word, (None, 0.0))[1] < weight:
                    places[word] = (term, weight)
            counted = Counter(places.values())
            total = sum(weight * min(n, MOST_COUNTED) for (_, weight), n in counted.items())
            return total / math.sqrt(1 + len(words) / 1000)

        return load

    def scorer(self):
        load = self.matcher()

        def score(text: str) -> float:
            z = self.intercept + self.slope * load(text)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _sketch(text: str) -> int:
    """The least hash of a text's word triples: near copies mostly share it."""
    words = text.lower().split()
    return min(
        (xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0
    ) - (1 << 63)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``words, toxic, part`` of labelled documents that may be learnt from.

    About ``most`` labels at most are drawn by a hash of the id and broadcast, so no text is
    shuffled for the join. Of near copies one stays, so that a group of copies does not make
    its own words look toxic. ``part`` splits rows for weights (0-3) from those for the line (4).
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    single = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = usable.count()
    share = min(1.0, most / max(1, count))
    drawn = single.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    joined = doc_text(docs).join(F.broadcast(drawn.withColumnRenamed("doc_id", "label_id")), F.expr("doc_id = label_id"))

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            words = [sorted(set(WORD.findall(fold(x)))) for x in texts]
            part = [xxhash.xxh32_intdigest(str(x)) % 5 for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, pa.string()),
                    pa.array(words, pa.list_(pa.string())),
                    batch.column("toxic"),
                    pa.array(part, pa.int32()),
                    pa.array([_sketch(x) for x in texts], pa.int64()),
                ],
                ["text", "words", "toxic", "part", "sketch"],
            )

    marked = map_batches(joined.select("doc_id", "text", "toxic"), run, "text string, words array<string>, toxic int, part int, sketch long")
    return durable(marked.dropDuplicates(["sketch"]).drop("sketch"))


def _counts(rows: DataFrame, found, key: str) -> DataFrame:
    """Documents by ``found(row words, text)`` term and label, added up in each task first."""

    def run(batches):
        count: dict[str, list[int]] = {}
        for batch in batches:
            for text, words, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "words", "toxic"))):
                for term in found(text, words):
                    count.setdefault(term, [0, 0])[toxic > 0] += 1
        if count:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(count), pa.string()),
                    pa.array([x[0] for x in count.values()], pa.int64()),
                    pa.array([x[1] for x in count.values()], pa.int64()),
                ],
                [key, "clean", "toxic"],
            )

    made = map_batches(rows, run, f"{key} string, clean long, toxic long")
    return made.groupBy(key).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _log_odds(hit: float, total: float) -> float:
    return math.log((hit + 0.5) / (total - hit + 0.5))


def _terms(rows: DataFrame, known, share: float, least: float, base: float) -> dict[str, float]:
    """Terms that toxic documents share, without those that say no more than a shorter one inside."""
    toxic_rows = rows.where("toxic > 0")
    few = max(MIN_SUPPORT, toxic_rows.count() // 200)
    first = _counts(toxic_rows, lambda text, words: pieces(words), "term")
    common = first.where(F.col("toxic") >= few).orderBy(F.desc("toxic"), "term").limit(TERMS)
    shared = [r.term for r in common.select("term").collect()]
    made: list = []

    def present(text, words):
        if not made:
            made.append(automaton({t: t for t in shared}))
        return {t for _, _, t in _matches(made[0], f" {'  '.join(words)} ")}

    rated = {}
    for r in _counts(rows, present, "term").collect():
        weight = math.log((r.toxic + 0.5) / (r.clean + 0.5)) - base
        if r.toxic >= few and r.clean <= share * r.toxic and weight >= least:
            rated[r.term] = (weight, r.toxic)
    kept: dict[str, float] = {}
    for term in sorted(rated, key=lambda t: (len(t), t)):
        weight, toxic = rated[term]
        inner = {term[i:j] for i in range(len(term)) for j in range(i + 4, len(term) + 1)} - {term}
        if not any(x in known or (x in kept and rated[x][1] >= toxic and rated[x][0] >= 0.8 * weight) for x in inner):
            kept[term] = weight
    return kept


def _unmatched(rows: DataFrame, terms) -> DataFrame:
    """Clean rows, and the toxic ones that hold none of the terms."""

    def run(batches):
        made = automaton({t: t for t in terms})
        for batch in batches:
            stay = [
                not toxic or next(_matches(made, f" {'  '.join(words)} "), None) is None
                for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist())
            ]
            yield batch.filter(pa.array(stay))

    return map_batches(rows, run, "text string, words array<string>, toxic int, part int")


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from the labelled documents that are not held out.

    Candidate terms are words and pieces of words that several toxic documents share. A term's
    weight is its log odds ratio of toxic against clean documents; terms that say no more than
    a shorter one inside them go. A second round serves toxic documents that the first missed. Words that contain a term but mostly stand in clean documents
    become exceptions. The line from load to score is fitted on documents that gave no weight.
    Without labels of both kinds only the fixed terms count.
    """
    rows = training_rows(docs, labels, most)
    fixed = {fold(t): SEED_WEIGHT for t in SEED_TERMS}
    totals = dict(rows.where("part < 4").groupBy("toxic").count().collect())
    n_toxic, n_clean = sum(n for y, n in totals.items() if y), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(fixed, EXCEPTIONS)
    fit = rows.where("part < 4")
    base = _log_odds(n_toxic, n_toxic + n_clean)
    kept = dict(fixed)
    for share, least in ROUNDS:
        kept |= _terms(_unmatched(fit, kept) if kept.keys() - fixed.keys() else fit, kept, share, least, base)

    made: list = []

    def around(text, words):
        if not made:
            made.append(automaton({t: t for t in kept}))
        return {w for w in words if any(w != t.strip() for _, _, t in _matches(made[0], f" {w} "))}

    words = _counts(fit, around, "word").where((F.col("clean") >= MIN_CLEAN) & (F.col("clean") > F.col("toxic")))
    excused = [r.word for r in words.orderBy(F.desc("clean"), "word").limit(TERMS).collect() if r.word not in kept]
    lexicon = Lexicon(kept, [*EXCEPTIONS, *excused])
    lexicon.intercept, lexicon.slope = _line(rows.where("part = 4"), lexicon)
    return lexicon


def _line(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Logistic regression of the label on the load."""

    def run(batches):
        load = lexicon.matcher()
        for batch in batches:
            loads = [load(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(loads), batch.column("toxic")], ["load", "toxic"])

    seen = map_batches(rows.select("text", "toxic"), run, "load double, toxic int").collect()
    x, y = np.array([r.load for r in seen]), np.array([r.toxic > 0 for r in seen], float)
    a, b = lexicon.intercept, lexicon.slope
    if y.min(initial=1) == y.max(initial=0):
        return a, b
    unit = x.std() or 1.0
    features = np.stack([np.ones(len(x)), x / unit])
    ridge = np.array([0.0, 1.0])

    def loss(c):
        z = c @ features
        return np.logaddexp(0, z).sum() - (y * z).sum() + (ridge * c * c).sum() / 2

    c = np.zeros(2)
    for _ in range(100):  # Newton steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(c @ features, -30, 30)))
        slope = features @ (p - y) + ridge * c
        step = np.linalg.solve((features * (p * (1 - p))) @ features.T + np.diag(ridge + 1e-6), slope)
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
        c = c - size * step
    a, b = c[0], c[1] / unit
    return float(a), max(0.0, float(b))


def score(docs: DataFrame, lexicon: Lexicon, *carry: str) -> DataFrame:
    """``doc_id, score`` (and the columns of ``carry``) of every row's whole text.

    Null and empty texts match nothing and get the score of an empty text. Repeated rows each
    give a row; a null ``doc_id`` is kept; an empty table gives an empty result; columns that
    are not carried are ignored. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        rate = shared.value.scorer()
        for batch in batches:
            scores = pa.array([rate(x or "") for x in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), scores, *(batch.column(c) for c in carry)], ["doc_id", "score", *carry]
            )

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry if c != "text")
    text = ", text string" if "text" in carry else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = doc_text(docs, *(c for c in carry if c != "text"))
    order = [*(c for c in carry if c != "text"), *(["text"] if text else [])]
    carry = tuple(order)
    return map_batches(own, run, f"doc_id {kind}, score double{kinds}{text}")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all others as they are."""
    lexicon = learn(docs, labels)
    more = [c for c in docs.columns if c not in ("doc_id", "text", "score")]
    if "score" in docs.columns:  # a column of the input that has our name is carried under another
        docs = docs.withColumnRenamed("score", "__score")
        more.append("__score")
    kept = score(docs, lexicon, "text", *more).where(F.col("score") < threshold).drop("score")
    kept = kept.withColumnRenamed("__score", "score") if "__score" in more else kept
    return kept.select(*[c if c != "__score" else "score" for c in docs.columns])
