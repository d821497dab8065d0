"""Registered queries on the smallest tables: against SQL where there is one, the pipeline against brute force."""

import glob
import html
import os
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_table_operators import groups_of, plain_lines
from tokenizers import Tokenizer

import __spark_entry__ as entries
from solekey.llm import decontaminate, queries, simhash, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = entries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    result = con.execute(entries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    expected = [tuple(dict(zip(columns, row))[c] for c in names) for row in result.fetchall()]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(expected, key=repr)


def test_every_operator_is_registered():
    assert {int(n.split("_")[0][2:]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entries.queries())


@pytest.mark.parametrize("name, columns", [
    ("op1_pii", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    ("op5_toxicity", "doc_id held_out score predicted"),
    ("op6_secrets", "doc_id n_assign n_access n_hex base_sha256 spans"),
])
def test_a_row_for_each_document(spark, name, columns):
    df = entries.queries()[name](spark, DATA)
    assert df.columns == columns.split()
    assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def rows_by_id(spark, name, table):
    """The registered query's rows and the table's, both by their first column."""
    found = entries.queries()[name](spark, DATA).collect()
    source = spark.read.parquet(f"{DATA}/{table}.parquet").collect()
    assert len({r[0] for r in source}) == len(source)
    return found, {r[0]: r for r in source}


def test_main_text_as_registered(spark):
    """The given pages hold their text in one article of paragraphs and a heading."""
    found, pages = rows_by_id(spark, "op3_main_text", "pages")
    assert len(found) == len(pages)
    for row in found:
        inside = re.search(r"<article[^>]*>(.*)</article>", pages[row.page_id].html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)(?:\s[^>]*)?>", inside)
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))) for b in blocks]
        text = "\n".join(b for b in (re.sub(r"\s+", " ", b).strip() for b in blocks) if b)
        assert (row.url, row.text, row.n_chars) == (pages[row.page_id].url, text, len(text))


def test_embeddings_as_registered(spark):
    found, vectors = rows_by_id(spark, "op7_embeddings", "embeddings")
    ids = sorted(vectors)
    x = np.array([vectors[i].embedding for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i != j]
    component = groups_of(len(ids), near)
    expected = {
        (ids[i], sum(a == i for a, _ in near), ids[component[i]], component[i] == i) for i in range(len(ids))
    }
    assert {tuple(r) for r in found} == expected


def test_packing_as_registered(spark):
    found, docs = rows_by_id(spark, "op9_packing", "documents")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, own in pieces.items():
        ids = [*tokenizer.encode(docs[doc_id].text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_simhash_as_registered(spark):
    found, docs = rows_by_id(spark, "op10_simhash", "documents")
    ids = sorted(docs)
    prints = [simhash.fingerprint(docs[i].text or "") for i in ids]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    component = groups_of(len(ids), near)
    assert {tuple(r) for r in found} == {(ids[i], f"{prints[i]:016x}", ids[component[i]]) for i in range(len(ids))}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rate = lexicon.scorer()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if rate(t) < 0.5]
    rows = [(i, text) for i, _, _, text in plain_lines(rows)]
    prints = [simhash.fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = groups_of(len(rows), near)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], doc), doc)
    rows = [(doc, t) for i, (doc, t) in enumerate(rows) if least[root[i]] == doc]
    items = [set(decontaminate.shingles(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = [set(decontaminate.shingles(t)) for _, t in rows]
    rows = [r for r, own in zip(rows, held) if not any(x and len(x & own) >= 0.8 * len(x) for x in items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    whole = {doc: tokenizer.encode(t, add_special_tokens=False).ids + [2] for doc, t in rows}
    covered, filled = dict.fromkeys(whole, 0), {}
    for p in corpus_pipeline.run(spark, DATA).collect():
        ids = whole[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32
        covered[p.doc_id] += p.length
        filled[p.sequence_id] = filled.get(p.sequence_id, 0) + p.length
    assert covered == {doc: len(ids) for doc, ids in whole.items()}
    assert max(filled.values()) <= 4096


def test_stages_keep_the_columns_of_documents_and_take_odd_rows(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, score string, kept_text int, n_lines int"
    rows = [(None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "a", 1, 2), (1, "", "en", "s", 0, "a", 1, 2)]
    rows += [(2, "some words " * 20_000, "en", "s", 3, "b", 1, 2), (3, "other words here", None, "s", 3, "c", 1, 2)]
    for docs in (spark.createDataFrame(rows, odd), spark.createDataFrame([], odd)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, DATA)
            if name != "packing":
                assert after.columns == docs.columns
            assert after.count() <= max(len(rows), 60)


def test_pipeline_keeps_its_last_stage_only(spark, monkeypatch):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    kept = lambda: sorted(os.path.join(d, n) for d in glob.glob(f"{folder}/pipeline-*") for n in os.listdir(d))
    before = kept()
    stages = [("first", lambda s, docs, d: docs), ("second", lambda s, docs, d: docs.limit(3)), ("third", lambda s, docs, d: docs)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, DATA).count() == 3
    (new,) = set(kept()) - set(before)
    assert new.endswith("/third")
    before = kept()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages, ("fourth", lambda s, docs, d: 1 / 0)])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, DATA)
    assert kept() == before
