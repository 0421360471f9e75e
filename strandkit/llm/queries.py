"""Queries of the text operators over the shared tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandkit.llm import bpe, collisions, html_text, licenses, mixing, phrases, pii, quality, simhash, spelling, suffixes, syncmers, warc
from strandkit.llm.common import documents


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_pages(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_pages(spark, sf_dir))).drop("payload")


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(documents(spark, sf_dir))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_bpe, op3_licenses, op4_html, op5_mixing, op6_simhash, op7_warc, op8_syncmers, op9_suffixes, op10_quality,
        op11_collisions, op12_phrases, op13_spelling,
    )
}
ORACLES: dict[str, str] = {"op3_licenses": licenses.sql(), "op5_mixing": mixing.SQL, "op10_quality": quality.SQL, "op12_phrases": phrases.SQL}
