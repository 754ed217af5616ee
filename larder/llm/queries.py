"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, html_extract, kmeans, licenses, near_dedup, packing, periodic_runs, pii, quality, sharding, substring_dedup, warc, window_packing
from larder.llm.common import read, shared_dir


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the threshold table for every document."""
    return quality.quality(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the place and the edits."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences of at most 2048 tokens."""
    return packing.packed(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended in four arrivals and compacted; every row with its shard."""
    docs = read(spark, sf_dir, "documents")
    shards = sharding.ShardSet(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for k in range(4):
        shards.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k))
        shards.compact()
    shards.expire()
    return sharding.placed(shards)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and wordings."""
    return licenses.licenses(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts, digest and spans."""
    return pii.find(read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that several documents have."""
    return substring_dedup.passages(read(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of every page; each not-modified answer with the response that it stands for."""
    found = warc.resolved(warc.page_captures(read(spark, sf_dir, "pages")))
    merged = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return found.select("page_id", "record_id", "canonical_url", F.unix_timestamp("date").alias("date"), "status", "verdict", "source_id", F.unix_timestamp("source_date").alias("source_date"), "digest", merged.alias("headers"))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences of at most 1024 tokens."""
    return window_packing.packed(read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector with its cluster, distance, inertias and its centroid's digest."""
    return kmeans.assignments(read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, after one text in ten was given a periodic end."""
    return periodic_runs.digests(periodic_runs.find(periodic_runs.with_planted_runs(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_pii": op7_pii,
    "op8_html_extraction": op8_html_extraction,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_window_packing": op11_window_packing,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Equal SQL for DuckDB, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op10_warc_revisits": warc.ORACLE,
    "op12_centroid_clustering": kmeans.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
