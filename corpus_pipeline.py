"""From raw documents to packed sequences; every stage is written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solekey.llm import decontaminate, line_dedup, packing, simhash, toxicity
from solekey.llm.frames import table
from solekey.llm.queries import TOKENIZER
from solekey.session import checkpoint_dir, delete


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; its lexicon is learnt from what is there."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one document only; ``n_chars`` follows the text."""
    # Other columns travel under names of their own, so that none clashes with the operator's.
    more = {c: f"__carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = line_dedup.drop_repeated_lines(
        docs.withColumnsRenamed(more), line_dedup.MIN_CHARS, line_dedup.MIN_DOCS, *more.values()
    ).select("doc_id", F.col("kept_text").alias("text"), *[F.col(new).alias(old) for old, new in more.items()])
    if "n_chars" in more:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.simhash_dedup(docs)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER)).drop("loss_tokens")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark_items),
    ("packing", packed),
]

# Fingerprints, sketches and token ids have no counterpart in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` below ``sf_dir``.

    A stage's folder goes as soon as the next one is written, and all of them after an error; the
    last one stays, as the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    before, finished = None, False
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if before:
                delete(spark, f"{base}/{before}")
            before = name
        finished = True
        return docs
    finally:
        if not finished:
            delete(spark, base)
