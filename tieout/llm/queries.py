"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tieout.llm import bpe, classifier, license_scan, media, packing, quality_rules, sharding, simhash, spelling, substring, toxicity, url_filter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.query(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.query(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(documents(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan,
            op2_sharding,
            op3_packing,
            op4_quality_rules,
            op5_media,
            op6_quality_classifier,
            op7_substring_dedup,
            op8_toxicity,
            op9_simhash,
            op10_bpe,
            op11_url_filter,
            op12_whitening,
            op13_spelling,
        )
    }


#: Words that stand in a window of 35 words which starts at another place too are removed.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), h AS (
  SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM s
), f AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), g AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM f
), t AS (
  SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE r IN (SELECT r FROM f))
), k AS (
  SELECT t.r, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN t.word END, ' ' ORDER BY t.p), '') AS kept
  FROM t LEFT JOIN g ON t.r = g.r AND t.p = g.p GROUP BY t.r
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": OP7_SQL, "op11_url_filter": url_filter.oracle()}
