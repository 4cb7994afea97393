"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm import (
    exact, langid, mixing, near, packing, quality, resampling, scoring, secrets, sharding, spelling, substrings, winnow,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda spark, sf_dir: quality.quality_rules(documents(spark, sf_dir)),
    "op2_language_id": lambda spark, sf_dir: langid.language_id(documents(spark, sf_dir)),
    "op3_best_fit_packing": lambda spark, sf_dir: packing.best_fit(documents(spark, sf_dir)),
    "op4_suffix_dedup": lambda spark, sf_dir: substrings.remove_repeats(documents(spark, sf_dir)),
    "op5_source_mixing": lambda spark, sf_dir: mixing.mixture(documents(spark, sf_dir)),
    "op6_secret_scan": lambda spark, sf_dir: secrets.secret_scan(documents(spark, sf_dir)),
    "op7_order_minhash": lambda spark, sf_dir: near.near_duplicates(documents(spark, sf_dir)),
    "op8_winnowing": lambda spark, sf_dir: winnow.fingerprints(documents(spark, sf_dir)),
    "op9_pseudo_likelihood": lambda spark, sf_dir: scoring.pseudo_likelihood(documents(spark, sf_dir)),
    "op10_extendible_shards": lambda spark, sf_dir: sharding.extendible_shards(documents(spark, sf_dir)),
    "op11_exact_dedup": lambda spark, sf_dir: exact.exact_duplicates(documents(spark, sf_dir)),
    "op12_importance_resampling": lambda spark, sf_dir: resampling.resample(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op13_spelling_variants": lambda spark, sf_dir: spelling.spelling_groups(documents(spark, sf_dir)),
    # all four kinds of evidence stand in raw pages only
    "page_languages": lambda spark, sf_dir: langid.language_id(
        langid.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id", host="host"),
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op4_suffix_dedup": substrings.SQL,
    "op5_source_mixing": mixing.SQL,
    "op6_secret_scan": secrets.SQL,
    "op8_winnowing": winnow.SQL,
    "op10_extendible_shards": sharding.SQL,
    "op11_exact_dedup": exact.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_spelling_variants": spelling.SQL,
}
