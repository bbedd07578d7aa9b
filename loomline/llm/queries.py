"""The registered queries: each operator with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, bytededup, decontamination, licences, mixing, nearest, neardup, recompression, toxicity, urlfilter

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    forest = urlfilter.fit(urlfilter.labelled_by_rules(pages, RULES))
    out = urlfilter.filter_urls(pages.select("page_id", "url"), RULES, forest)
    return out.select("page_id", "host", "path", "rule", "verdict", "probability")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its notices' families, and the notices."""
    docs = table(spark, sf_dir, "documents")
    found = licences.licences(docs, licences.fit(docs))
    notices = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.count("*").alias("n_notices"), F.min("probability").alias("least_probability"))
    out = docs.select("doc_id").join(notices, "doc_id", "left")
    return out.select("doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), "least_probability")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_tokens", "coverage")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.fold(of=5) != 0))
    out = toxicity.toxicity(docs, model)
    return out.select("doc_id", (toxicity.fold(of=5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def _codec() -> tuple[str, str]:
    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *_codec()), *_codec())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.fold(of=7) == 2
    out = mixing.scores(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytededup.byte_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_url_filter, op3_nearest, op4_licences, op5_decontamination, op6_substring_dedup, op7_toxicity, op8_bpe, op9_lm_scores, op10_byte_dedup)
}

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)""",
    "op6_substring_dedup": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM v JOIN f USING (g) WHERE f.first < v.doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
