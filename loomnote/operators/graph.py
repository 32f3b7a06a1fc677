"""The link graph: resolution, lookups, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote import session
from loomnote.functions import text as X


def note_keys(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, path) with the last path in order for a key, and (stem_key, path) of the stems that only one note has."""
    keyed = notes.select("path", X.note_key("path").alias("key"), X.casefold(X.stem(F.col("path"))).alias("stem_key"))
    by_key = keyed.groupBy("key").agg(F.max_by("path", F.split("path", "/")).alias("path"))
    by_stem = keyed.groupBy("stem_key").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    return by_key, by_stem


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges: a target is looked up as a path, then beside its source, then by a name that only one note has.

    Three left joins on equal keys; Spark broadcasts the lookups while they are small and shuffles beyond that.
    """
    by_key, by_stem = note_keys(notes)
    target = X.link_target(F.col("raw_target"))
    rows = links.withColumn("target", target)
    folder = F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("target", r"/+", "/"), r"(?:^|(?<=/))\./", ""), r"(?<=.)/+$", "")
    beside = F.when(F.col("target").contains("/"), F.when(F.col("target").startswith("/"), clean).when(folder == "", clean).otherwise(F.concat(folder, F.lit("/"), clean)))
    name = F.regexp_extract(F.regexp_replace("target", r"/+$", ""), r"([^/]*)$", 1)
    keys = {"k1": X.note_key(F.when(F.col("target") != "", F.col("target"))), "k2": X.note_key(beside), "k3": X.casefold(F.when(F.col("target") != "", name))}
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64("source_path", "start_line"), F.lit(1 << 12)))  # no path has this key; nulls would all meet in one task
    rows = rows.withColumns(keys).withColumns({k: F.coalesce(k, none) for k in keys})
    rows = rows.join(by_key.select(F.col("key").alias("k1"), F.col("path").alias("p1")), "k1", "left")
    rows = rows.join(by_key.select(F.col("key").alias("k2"), F.col("path").alias("p2")), "k2", "left")
    rows = rows.join(by_stem.select(F.col("stem_key").alias("k3"), F.col("path").alias("p3")), "k3", "left")
    return rows.select("source_path", "raw_target", F.coalesce("p1", "p2", "p3").alias("resolved_target_path"), "start_line")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target and line."""
    return edges.dropDuplicates(["source_path", "raw_target", "start_line"])


def find_notes(notes: DataFrame, reference: str) -> list[str]:
    """Paths whose key is the reference's, else those whose name is its last part."""
    key = X.fold_key(reference)
    exact = [r.path for r in notes.where(X.note_key("path") == key).select("path").orderBy("path").collect()]
    return exact or [r.path for r in notes.where(X.casefold(X.stem(F.col("path"))) == key.rstrip("/").rsplit("/", 1)[-1]).select("path").orderBy("path").collect()]


def outbound(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("source_path") == path).select("raw_target", "resolved_target_path", "start_line").orderBy("start_line", "raw_target")


def inbound(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("resolved_target_path") == path).select("source_path", "raw_target", "start_line").orderBy("source_path", "start_line", "raw_target")


def degrees(edges: DataFrame, source: str = "source_path", target: str = "resolved_target_path") -> DataFrame:
    """(node, n_out, n_in) of all nodes, in one aggregate."""
    both = edges.select(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.where(F.col(target).isNotNull()).select(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where("resolved_target_path is null")


def orphans(nodes: DataFrame, edges: DataFrame, node: str = "path", source: str = "source_path", target: str = "resolved_target_path") -> DataFrame:
    """Nodes that no resolved edge leaves or reaches."""
    linked = edges.where(F.col(target).isNotNull()).select(F.explode(F.array(source, target)).alias(node)).distinct()
    return nodes.select(node).join(linked, node, "left_anti")


def n_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): all that ``start`` (node) reaches in at most ``depth`` steps over ``edges`` (src, dst), either way.

    One join for each step; the frontier of each step is checkpointed, so plans don't grow.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    edge = seen
    for step in range(1, depth + 1):
        edge = session.cut(edge.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(step)))
        seen = seen.unionByName(edge)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str] | None:
    """The nodes of a shortest chain between two nodes, the first by name among equals; None if there is no chain."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    edge = edges.sparkSession.createDataFrame([(source, None)], "node string, via string")
    layers = []
    seen = edge
    while True:
        if edge.where(F.col("node") == target).limit(1).count():
            break
        layers.append(edge)
        edge = session.cut(edge.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via")).join(seen.select("node"), "node", "left_anti"))
        if not edge.limit(1).count():
            return None
        seen = session.cut(seen.unionByName(edge))
    chain = [target]
    for layer in [edge, *reversed(layers)]:
        via = layer.where(F.col("node") == chain[-1]).first().via
        if via is None:
            break
        chain.append(via)
    return chain[::-1]


def unlinked_mentions(found: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Search results (path) that don't link to ``path``."""
    return found.join(edges.where(F.col("resolved_target_path") == path).select(F.col("source_path").alias("path")).distinct(), "path", "left_anti").where(F.col("path") != path)


def without_anti_links(candidates: DataFrame, anti: DataFrame, a: str, b: str) -> DataFrame:
    """Candidate pairs without those that an anti-link (a, b), in either order, rules out."""
    both = anti.select(a, b).unionByName(anti.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()
    return candidates.join(both, [a, b], "left_anti")


def as_of(links: DataFrame, revisions: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each link with the revision of its target that was current when the link was written (null: none yet).

    A union sorted by (key, time) and one window carry the last revision forward: one shuffle, no range join.
    """
    lone = [c for c in links.columns if c != key]
    left = links.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_o"), F.struct(*lone).alias("_row"), F.lit(None).cast(revisions.schema[value].dataType).alias("_v"))
    right = revisions.select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    past = Window.partitionBy("_k").orderBy("_t", "_o", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("_last", F.last("_v", ignorenulls=True).over(past)).where("_o = 1").select(F.col("_k").alias(key), "_row.*", F.col("_last").alias(value))
