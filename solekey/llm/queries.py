"""Registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solekey.llm import (
    byte_bpe,
    decontaminate,
    embeddings,
    hard_negatives,
    line_dedup,
    main_text,
    packing,
    pii,
    secrets,
    simhash,
    spelling,
    toxicity,
    url_rules,
)
from solekey.llm.frames import held_out, table

TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def _joined(spans, certain: bool):
    """Spans as ``kind:start:end``, comma-joined."""
    own = F.filter(spans, lambda s: s["certain"]) if certain else spans
    return F.array_join(
        F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["certain"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def _digest(found: DataFrame, kinds) -> DataFrame:
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[_count(spans, kind) for kind in kinds],
        F.sha2(_joined(spans, True).cast("binary"), 256).alias("base_sha256"),
        _joined(spans, False).alias("spans"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS)


# The rules of the query, as (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.KINDS)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.drop("loss_tokens")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    print_hex = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select("doc_id", print_hex.alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.count_words(words))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    found = hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, scale=256)
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = (public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), *ranks)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return byte_bpe.decode(encoded, *ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line,
    translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
      '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_SHINGLES_SQL = """SELECT {id}, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT {id}, words, unnest(generate_series(1, len(words) - 4)) AS i
    FROM (SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{up}', '{low}'),
      '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {table}) WHERE len(words) >= 5)"""

OP8_SQL = f"""
WITH docs AS (SELECT DISTINCT * FROM ({_SHINGLES_SQL.format(id="doc_id", table="documents", up=_UPPER, low=_LOWER)})),
items AS (SELECT DISTINCT * FROM ({_SHINGLES_SQL.format(id="item_id", table="benchmark", up=_UPPER, low=_LOWER)})),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM docs JOIN items USING (shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item"""

OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, '.' || host AS h, CASE
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c, list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x)) AS points
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS run
        FROM documents) GROUP BY doc_id, run
), bytes AS (
  SELECT run, c, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END))
    AS bytes FROM runs
), hashed AS (
  -- crc32: take in a byte, then shift eight times (marked -1).
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) ELSE xor(h >> 1, 3988292384 * (h & 1)) END)) AS h FROM bytes
), cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word, c FROM hashed
), w AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), d AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS part FROM (SELECT word, unnest(range(length(word))) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM d AS a JOIN d AS b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.part
  UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.part
), best AS (
  SELECT a AS word, count(*) AS n_near, min({{'less': -n, 'b': b}}) AS best FROM near JOIN w ON w.word = near.b GROUP BY a
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.b END AS form,
    CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM w LEFT JOIN best ON w.word = best.word
), steps AS (
  SELECT word, word AS at FROM formed UNION ALL
  SELECT steps.word, f.form FROM steps JOIN formed AS f ON f.word = steps.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, steps.at AS root, f.n, f.n_near, f.form_n FROM formed AS f JOIN steps ON steps.word = f.word
WHERE NOT EXISTS(SELECT 1 FROM formed AS g WHERE g.word = steps.at AND g.form IS NOT NULL)"""

OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_rules": op2_url_rules,
    "op3_main_text": op3_main_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_embeddings": op7_embeddings,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL = {
    "op2_url_rules": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_spelling": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
