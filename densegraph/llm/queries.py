"""The text operators as queries over the whole tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegraph.llm import cotrain, decontaminate, html_text, near_dup, quality_rules, secrets, spm, substring, token_count, toxicity
from densegraph.llm.common import save


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = save(secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text"))
    spans = secrets.secret_spans(found, found=found)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"), secrets.listed(F.col("secret_spans")).alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = save(quality_rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return quality_rules.quality_rules(figures, figures=figures).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_decode(table(spark, sf_dir, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_cotraining, op2_secret_scan, op3_token_counts, op4_quality_rules, op5_benchmark_leaks, op6_toxicity, op7_near_duplicates, op8_sentencepiece, op9_substring_dedup, op10_page_text)
    return {f.__name__: f for f in every}


#: DuckDB's split on the word class, without the empty strings at the ends.
_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def oracle_sql() -> dict[str, str]:
    near = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM docs
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, to_id) AS (
  SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.to_id
), least AS (SELECT doc_id, min(to_id) AS m FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id))::BIGINT AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least USING (doc_id)"""
    repeats = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM starts),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE k > 1)),
kept AS (
  SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.j) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM docs) d LEFT JOIN gone USING (doc_id, j) WHERE gone.j IS NULL GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""
    return {"op7_near_duplicates": near, "op9_substring_dedup": repeats}
