"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import captures, classifier, decontaminate, exact, jaccard, licences, lines, mixing, sharding, urls

Query = Callable[[SparkSession, str], DataFrame]
NEAR = dict(n=5, threshold=0.5)
LINES = dict(long_words=50)
SHARDS = 64
MIX = dict(block=512, power=0.7, slots_a_shard=4096)
CLASSIFIER = dict(sample=1500)
LISTED_HOSTS = "(^|[.-])(casino|poker|bets?|adult|xxx|porn|warez|pills|viagra|spam|ads)([.-]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(spark, table(spark, sf_dir, "documents"), **LINES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **CLASSIFIER)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, table(spark, sf_dir, "documents"), **MIX)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL, in any spelling, is on the list; the list holds the pages of hosts with a listed word."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)).rlike(LISTED_HOSTS)).select("url")
    return urls.filter_urls(spark, pages, listed)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture histories of the pages; the table has no times, so that each page's is worked out from its id."""
    two = lambda base, by, n: F.lpad((F.lit(base) + F.col("page_id") * by % n).cast("string"), 2, "0")
    pages = table(spark, sf_dir, "pages").withColumn("capture_time", F.concat(F.lit("2024"), two(1, 7, 12), two(1, 13, 28), two(0, 31, 24), F.lit("0000")))
    return captures.capture_histories(spark, pages)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents laid out as files: the table has no paths, so source, language and id give each its place, and every sixteenth is its directory's LICENSE."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 16 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan_licences(spark, docs.withColumn("path", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 256).cast("string"), F.floor(F.col("doc_id") / 64).cast("string"), name)))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(spark, table(spark, sf_dir, "documents"), **NEAR)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_source_mixing": op5_source_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_warc_index": op7_warc_index,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_licence_scan": op9_licence_scan,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

URLS_SQL = f"""
WITH listed AS (SELECT {urls.canonical_sql("url")} AS key FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '{LISTED_HOSTS}'))
SELECT page_id, {urls.canonical_sql("url")} AS canonical_url, coalesce({urls.canonical_sql("url")} IN (SELECT key FROM listed WHERE key IS NOT NULL), false) AS listed FROM pages"""

CAPTURED_SQL = "'2024' || lpad((1 + page_id * 7 % 12)::VARCHAR, 2, '0') || lpad((1 + page_id * 13 % 28)::VARCHAR, 2, '0') || lpad((page_id * 31 % 24)::VARCHAR, 2, '0') || '0000'"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.lines_sql(**LINES),
    "op2_sharding": sharding.shards_sql(SHARDS),
    "op6_url_filter": URLS_SQL,
    "op7_warc_index": captures.captures_sql(CAPTURED_SQL),
    "op8_exact_dedup": exact.EXACT_SQL,
    "op10_ngram_jaccard_join": jaccard.ngram_jaccard_sql(**NEAR),
}
