"""Agent sessions and catalogs of repositories: what touched a file, what failed, where to look, and rolling up answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote import session
from loomnote.operators import search


def touching(turns: DataFrame, pattern: str, files: str = "files_touched") -> DataFrame:
    """Turns of which any file (an array column) is LIKE ``pattern``."""
    return turns.where(F.exists(files, lambda f: f.like(pattern)))


def provenance(turns: DataFrame, path: str, files: str = "files_touched") -> DataFrame:
    """Turns that touched exactly this file."""
    return turns.where(F.array_contains(files, path))


def failed(turns: DataFrame, status: str = "status") -> DataFrame:
    """Turns that ended in an error."""
    return turns.where(F.col(status) == "error")


def route(catalog: DataFrame, query_terms: list[str], most: int = 5, repo: str = "repo", text: str = "description") -> DataFrame:
    """(repo, score, rank): the repositories whose descriptions fit the terms best, in one scan of the catalog."""
    scored = search.scan_bm25(catalog, repo, F.col(text), query_terms).select(F.col("id").alias(repo), F.round("score", 6).alias("score"))
    return search.ranked(scored, [F.col("score"), F.col(repo)], most, "rank")


def symbols(table: DataFrame, repos: list[str], query: str, repo: str = "repo", name: str = "symbol") -> DataFrame:
    """Symbols of some repositories that have ``query`` in their name; both filters reach the scan. Whole names come first."""
    found = table.where(F.col(repo).isin(repos) & F.contains(F.lower(name), F.lit(query.lower())))
    return found.orderBy(F.lower(name) != query.lower(), repo, name)


def rollup(rows: DataFrame, reduce: Callable[[list[str]], str], fan_in: int = 40, key: str = "key", text: str = "text") -> DataFrame:
    """(key, text): the texts of each key reduced ``fan_in`` (2 at least) at a time, level by level, until each key has one.

    ``reduce`` gets at most ``fan_in`` texts, so no task or call has a key's texts all at once: they are dealt by a hash,
    equal ones in lots, and what a hash brings together beyond that is cut. Null texts count for nothing; a key may be null.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 at least")
    reducing = F.pandas_udf(lambda s: pd.Series([reduce(list(x)) for x in s], dtype=object), T.StringType())
    level = session.cut(rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    while True:
        sizes = level.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"))
        if not sizes.where("n > 1").limit(1).count():
            return level.select(F.col("key").alias(key), F.col("text").alias(text))
        equal = level.groupBy("key", "text").agg(F.count("*").alias("m"))
        lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / fan_in))))
        lots = lots.withColumn("texts", F.array_repeat("text", F.least(F.col("m") - F.col("lot") * fan_in, F.lit(fan_in)).cast("int")))
        lots = lots.join(sizes, F.col("key").eqNullSafe(F.col("k"))).withColumn("part", F.pmod(F.xxhash64("text", "lot"), F.ceil(F.col("n") / fan_in)))
        parts = lots.groupBy("key", "part").agg(F.flatten(F.sort_array(F.collect_list("texts"))).alias("texts"))
        starts = F.sequence(F.lit(0), F.floor((F.size("texts") - 1) / fan_in).cast("int"))
        level = session.cut(parts.select("key", F.explode(F.transform(starts, lambda k: F.slice("texts", k * fan_in + 1, fan_in))).alias("texts")).select("key", reducing("texts").alias("text")))
