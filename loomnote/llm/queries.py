"""The ten operators' queries over the tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomnote import session
from loomnote.llm import archive, bpe, dac, hosts, langid, licenses, packing, quality, simhash, tokencount


def ranks_path() -> str:
    """The rank file: of the installed vocabularies, or at ``LOOMNOTE_RANKS``."""
    if path := os.environ.get("LOOMNOTE_RANKS"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


SUFFIXES = "/usr/share/publicsuffix/public_suffix_list.dat"


@functools.cache
def suffix_rules() -> hosts.Rules:
    """The public suffixes: of the system's list, or of a file of its format at ``LOOMNOTE_SUFFIXES``; else a few."""
    path = os.environ.get("LOOMNOTE_SUFFIXES", SUFFIXES)
    return hosts.read_rules(path) if os.path.exists(path) else hosts.RULES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ranks_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = session.scratch(spark, "media")
    archive.write_archives(_table(spark, sf_dir, "pages"), folder, "page_id", "html")
    return archive.media_columns(archive.read_archives(spark, folder), "page_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.detect(docs, langid.train(docs))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.write_tokens(_table(spark, sf_dir, "documents"), ranks_path())


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), ranks_path())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.reputation(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), suffix_rules())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), ranks_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_media_columns": op5_media_columns,
    "op6_language_id": op6_language_id,
    "op7_token_binary": op7_token_binary,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_media_columns": "select page_id, strlen(html)::bigint as n_bytes, sha256(html) as sha256, null::varchar as error from pages",
    "op9_url_filter": hosts.sql(suffix_rules()),
}
