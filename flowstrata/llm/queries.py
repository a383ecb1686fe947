"""Registered training-data queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    collocations,
    html_extract,
    license_scan,
    line_templates,
    mixing,
    near_dup,
    neighbours,
    periodic_runs,
    quality,
    secret_scan,
    sharding,
    url_filter,
)
from .oracles import ORACLES  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
REGISTRY = {}


def register(query):
    REGISTRY[query.__name__] = query
    return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_url_filter(spark, sf_dir):
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"))


@register
def op2_license_scan(spark, sf_dir):
    return license_scan.scan_documents(_table(spark, sf_dir, "documents"))


@register
def op3_entropy_mix(spark, sf_dir):
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


@register
def op4_nn_descent(spark, sf_dir):
    return neighbours.search_embeddings(_table(spark, sf_dir, "embeddings"))


@register
def op5_near_dup(spark, sf_dir):
    return near_dup.mark_documents(_table(spark, sf_dir, "documents"))


@register
def op6_quality_rules(spark, sf_dir):
    return quality.judge_documents(_table(spark, sf_dir, "documents"))


@register
def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


@register
def op8_byte_bpe(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@register
def op9_line_templates(spark, sf_dir):
    return line_templates.clean_documents(_table(spark, sf_dir, "documents"))


@register
def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@register
def op11_html_extract(spark, sf_dir):
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


@register
def op12_collocations(spark, sf_dir):
    return collocations.top_phrases(_table(spark, sf_dir, "documents"))


@register
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digest_documents(_table(spark, sf_dir, "documents"))
