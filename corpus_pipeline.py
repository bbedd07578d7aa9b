"""A corpus from documents to tokens: toxicity, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and is written and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.llm import bpe, decontamination, neardup, recompression, toxicity
from loomline.llm.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the toxicity model, learned from the labelled ones of the training folds, predicts as
    toxic: rows of one doc_id go together, and rows without one stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.fold(of=5) != 0)
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    toxic = toxicity.toxicity(docs, model).where("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates. Rows of one doc_id stay or go
    together, and rows without one stay."""
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in a document with a smaller doc_id; a text without such stays as it is, and so
    does that of a row without a doc_id. Every row stays one row, whether or not rows repeat."""
    key = ["doc_id", "text_key"]
    kept = recompression.substring_dedup(docs, layout=True).groupBy("doc_id", F.col("source").alias("text_key")).agg(F.first("text").alias("kept"))
    out = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, key, "left")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce("kept", "text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold half or more of a benchmark item's tokens."""
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text's bytes."""
    codec = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(docs, *codec)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: Trained and iterative stages cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
