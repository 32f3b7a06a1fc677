"""The index as a whole: build, search, duplicate check, links, statistics; and the command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote import schemas, session
from loomnote.functions import text as X
from loomnote.operators import build, events, graph, lifecycle, notes, search
from loomnote.operators.embedder import OnnxEmbedder
from loomnote.sources import vault


VECTORS = schemas.struct("sha256 string, embedding_model string, chunking_version string, vector array<float>")
EMBED_ROUND = 100_000  # sections


def _where(root: str | None, index: str | None) -> tuple[str, str]:
    base = str(root) if root and ":" in str(root).split("/")[0] else str(Path(root).resolve() if root else vault.find_root())  # a URI stays as it is
    return base, index or f"{base.rstrip('/')}/.obsidian/note_index"


def build_index(spark: SparkSession, root: str | None = None, index: str | None = None, skip_embeddings: bool = False, embedder: search.Embedder | None = None, embed_round: int = EMBED_ROUND) -> dict:
    """Parse all notes, reuse the vectors of texts that didn't change, embed the others, write a new snapshot.

    Without an embedder, or with ``skip_embeddings``, new texts have no vector. Each task keeps its vectors ``embed_round``
    at a time: 128 suits a folder of notes on a slow machine, the default a cluster. Returns the counts.
    """
    session.ship(spark)
    base, folder = _where(root, index)
    store = lifecycle.Store(spark, folder)
    with store.lock():
        return _build(spark, store, base, skip_embeddings, embedder, embed_round)


def _build(spark: SparkSession, store: lifecycle.Store, base: str, skip_embeddings: bool, embedder: search.Embedder | None, embed_round: int) -> dict:
    run, started = store.new_run(), datetime.now(timezone.utc)
    store.compact("vectors", ["sha256", "embedding_model", "chunking_version"])
    known, before = store.log("vectors", VECTORS), store.current()
    old = store.table("sections", schemas.SECTIONS) if before else session.empty(spark, schemas.SECTIONS)
    cached = old.select("id", "sha256", "embedding_model", "chunking_version", "vector").unionByName(known.withColumn("id", F.lit(None).cast("string")), allowMissingColumns=True)
    embeds, kept, missing = bool(embedder) and not skip_embeddings, {}, None
    fill = search.filler(embedder, schemas.DIMENSIONS, _keep(f"{store.folder}/vectors"), embed_round) if embeds else None  # vectors are kept as they are made, whatever happens to the rest
    reuses = lifecycle.reusable(cached, schemas.MODEL, schemas.CHUNKING).limit(1).count() > 0
    counts = build.scan(spark, base, store.home(run), store.home(before["run"]) if before else None, "fresh" if reuses else "sections", None if reuses else fill, carry=not reuses)
    if reuses:  # vectors are matched by id and hash; where there are none, sections are whole as they are scanned
        reused = lifecycle.reuse(spark.read.parquet(store.place(run, "fresh")).drop("vector"), cached, schemas.MODEL, schemas.CHUNKING)
        joined = store.write(run, "joined", reused.repartitionByRange("path", "id").sortWithinPartitions("path", "id"))
        kept = {r.reused: r["count"] for r in joined.groupBy("reused").count().collect()}
        missing = kept.get(None, 0)
        counts["vectors"] = search.write_sections(joined.select(*schemas.SECTIONS.names), store.place(run, "sections"), fill)
        for name in ("fresh", "joined"):
            store.drop(run, name)
    parsed, section_rows = (spark.read.parquet(store.place(run, name)) for name in ("parsed", "sections"))
    note_rows = store.write(run, "notes", notes.notes(parsed).select(*schemas.NOTES.names))
    titles = search.write_index(note_rows.select("path", X.stem(F.col("path")).alias("title")), "path", "title", store.place(run, "titles_postings"))
    for name, found in (("sections", counts), ("titles", titles)):
        store.write(run, f"{name}_stats", session.rows(spark, [(found["docs"], found["tokens"])], schemas.STATS))
    made = 0 if not embeds else counts["vectors"] if missing is None else missing
    n_edges = build.edges(spark, store.home(run), store.home(before["run"]) if before else None)
    failed = notes.errors(parsed)
    old_notes = store.table("notes", schemas.NOTES) if before else session.empty(spark, schemas.NOTES)
    gone = lifecycle.stale(old_notes, note_rows, "path").count(), lifecycle.stale(old, section_rows, "id").count()
    n_notes, n_sections, n_vectors, n_links, n_errors = titles["docs"], *(counts[n] for n in ("docs", "vectors", "links", "errors"))
    runs = store.log("index_runs", schemas.RUNS)
    run_id = (runs.agg(F.max("id")).first()[0] or 0) + 1
    status = "metadata-only" if skip_embeddings or not embedder else "complete"
    store.append("index_errors", failed.select(F.lit(run_id).cast("long").alias("run_id"), "path", "stage", "message"))
    store.append("index_runs", session.rows(spark, [(run_id, started, datetime.now(timezone.utc), base, status, n_notes, n_sections, n_vectors, n_errors)], schemas.RUNS))
    last = (before or {}).get("run", run)
    store.put({"schema_version": schemas.SCHEMA_VERSION, "embedding_model": schemas.MODEL, "chunking_version": schemas.CHUNKING})
    store.commit(run)
    store.prune({run, last})
    print(f"{n_notes:,} notes, {n_sections:,} sections, {n_links:,} links ({n_edges:,} distinct).")
    print(f"Vectors: {kept.get('id', 0):,} as before, {kept.get('hash', 0):,} by hash, {made:,} new. Gone: {gone[0]:,} notes, {gone[1]:,} sections.")
    print(f"{status}, {n_errors} errors. {counts['carried']:,} ranges of notes were as before.")
    return {"notes": n_notes, "sections": n_sections, "links": n_links, "vectors": n_vectors, "errors": n_errors, "run_id": run_id}


def _keep(folder: str) -> Callable[[pa.Array, pa.Array], None]:
    """Adds (hashes, vectors) to the log of vectors."""

    def keep(sha256: pa.Array, vectors: pa.Array) -> None:
        n = len(sha256)
        vault.write_table(folder, pa.table([sha256, pa.repeat(schemas.MODEL, n), pa.repeat(schemas.CHUNKING, n), vectors], names=VECTORS.names), use_dictionary=VECTORS.names[:3])

    return keep


def append_link_events(store: lifecycle.Store, log: DataFrame) -> None:
    """Append the link events of a git log (``vault.git_log``) to the index; a log given twice counts twice."""
    with store.lock():
        store.append("link_events", events.link_history(log).select(*schemas.LINK_EVENTS.names))


def index_history(spark: SparkSession, log: str, index: str, embedder: search.Embedder | None = None, authors: list[str] | None = None, since: str | None = None, until: str | None = None) -> int:
    """Append what ``git log -p`` output at ``log`` says of links and of deleted text, the latter by some authors and days; returns the deleted chunks."""
    session.ship(spark)
    store, lines = lifecycle.Store(spark, index), vault.git_log(spark, log)
    append_link_events(store, lines)
    gone = session.cut(events.scoped(events.deleted_chunks(lines), authors, since, until).withColumn("sha256", F.sha2("text", 256)))
    if embedder:
        once = gone.select("sha256", "text").dropDuplicates(["sha256"]).withColumn("id", F.col("sha256"))
        gone = gone.join(search.embed(once, embedder, schemas.DIMENSIONS).select("sha256", "vector"), "sha256", "left")
    with store.lock():
        store.append("git_history_chunks", schemas.evolve(gone, schemas.DELETED_CHUNKS))
    return gone.count()


def search_history(spark: SparkSession, query: str, embedder: search.Embedder, index: str, authors: list[str] | None = None, since: str | None = None, until: str | None = None, limit: int = 10) -> list[dict]:
    """Deleted chunks by similarity: raw_sim, path, sha, date, author, text."""
    session.ship(spark)
    rows = events.scoped(lifecycle.Store(spark, index).log("git_history_chunks", schemas.DELETED_CHUNKS), authors, since, until)
    near = search.cosine(rows.where("vector is not null"), _unit(embedder, query)).drop("vector")
    return [r.asDict() for r in near.orderBy(F.col("raw_sim").desc(), "sha", "path", "text").limit(limit).collect()]


def _unit(embedder: search.Embedder, query: str) -> list[float]:
    v = [float(x) for x in embedder([query])[0]]
    norm = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / norm for x in v]


def _opened(spark: SparkSession, root: str | None, index: str | None) -> lifecycle.Store | None:
    session.ship(spark)
    store = lifecycle.Store(spark, _where(root, index)[1])
    if store.exists():
        return store
    print(f"There is no index at {store.folder}. Build it first.")
    return None


def _results(store: lifecycle.Store, query: str, embedder: search.Embedder | None, limit: int) -> DataFrame:
    sections = store.table("sections", schemas.SECTIONS)
    vector = None
    if embedder:
        vector = _unit(embedder, query)
    elif sections.where("vector is not null").limit(1).count():
        print("There is no embedder: lexical results only.")
    return search.hybrid(sections, store.table("sections_postings"), store.table("sections_stats"), query, vector, schemas.MODEL, schemas.CHUNKING, limit)


def search_index(spark: SparkSession, query: str, root: str | None = None, index: str | None = None, limit: int = 10, embedder: search.Embedder | None = None) -> list[dict]:
    """Hybrid search results, best first."""
    store = _opened(spark, root, index)
    if store is None:
        return []
    return [r.asDict() for r in _results(store, query, embedder, limit).drop("id").collect()]


def semantic_search(spark: SparkSession, query: str, embedder: search.Embedder, index: str | None = None, top_k: int = 10) -> list[tuple]:
    """(similarity, path, heading, line) by vectors alone, of any model and version."""
    store = _opened(spark, None, index)
    if store is None:
        return []
    columns = store.table("sections", schemas.SECTIONS).where("vector is not null").select("id", "path", "heading", "start_line", "vector")  # texts aren't read
    rows = search.cosine(columns, _unit(embedder, query)).drop("vector")
    return [(r.raw_sim, r.path, r.heading, r.start_line) for r in rows.orderBy(F.col("raw_sim").desc(), "id").limit(top_k).collect()]


def check_duplicate(spark: SparkSession, title: str, root: str | None = None, index: str | None = None, embedder: search.Embedder | None = None) -> list[dict]:
    """Notes that may be about the same: title matches first, then by similarity; 5 at most."""
    store = _opened(spark, root, index)
    if store is None:
        return []
    phrases = X.query_phrases(title)
    titles = spark.createDataFrame([], "path string, title_rank int")
    if phrases:
        hits = search.bm25(store.table("titles_postings"), store.table("titles_stats"), phrases)
        titles = search.ranked(hits, [F.col("score"), F.col("id")], 5, "title_rank").select(F.col("id").alias("path"), "title_rank")
    found = [(r.path, r.raw_sim, k) for k, r in enumerate(_results(store, title, embedder, 10).collect(), 1)]
    rows = [r.asDict() for r in search.duplicate_candidates(titles, spark.createDataFrame(found, "path string, raw_sim double, rank int")).collect()]
    for n, row in enumerate(rows):
        why = [f"{label} {value:{form}}" for label, value, form in (("title rank", row["title_rank"], "d"), ("cosine", row["raw_sim"], ".3f")) if value is not None]
        print(f"  {n + 1}. {row['path']}", *why, sep="; ")
    if not rows:
        print("No note is like it.")
    return rows


def query_links(spark: SparkSession, reference: str, root: str | None = None, index: str | None = None) -> dict | None:
    """A note's links, both ways; None where no note, or more than one, fits the reference."""
    store = _opened(spark, root, index)
    if store is None:
        return None
    paths = graph.find_notes(store.table("notes", schemas.NOTES), reference)
    if len(paths) != 1:
        print(f"{len(paths)} notes fit {reference!r}" + "".join(f"\n  {p}" for p in paths[:20]))
        return None
    edges = store.table("edges", schemas.EDGES)
    out = {"path": paths[0], "outbound": [tuple(r) for r in graph.outbound(edges, paths[0]).collect()], "inbound": [tuple(r) for r in graph.inbound(edges, paths[0]).collect()]}
    for name, arrow in (("outbound", "->"), ("inbound", "<-")):
        print(f"{name} ({len(out[name])})")
        for row in out[name][:20]:
            print(f"  {arrow} " + (f"{row[1] or row[0]} (line {row[2]})" if name == "outbound" else f"{row[0]}:{row[2]} as [[{row[1]}]]"))
        if len(out[name]) > 20:
            print(f"  and {len(out[name]) - 20} more")
    return out


def print_stats(spark: SparkSession, root: str | None = None, index: str | None = None) -> dict | None:
    """Counts of the current snapshot, and the last run."""
    store = _opened(spark, root, index)
    if store is None:
        return None
    row = lifecycle.statistics(store.table("notes"), store.table("sections"), store.table("edges")).first().asDict()
    row |= {"text_rows": store.table("sections_stats").first().docs, "title_rows": store.table("titles_stats").first().docs, "bytes": store.size()}
    last = lifecycle.latest_run(store.log("index_runs", schemas.RUNS)).first()
    for k, v in row.items():
        print(f"{k}: {v:,}")
    if last:
        row |= {"status": last.status, "errors": last.error_count}
        print(f"last run: {last.status} at {last.completed_at} ({last.error_count} errors)")
    return row


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomnote", description="Index a folder of Markdown notes and search it.")
    for flag, what in (("vault", "folder of notes"), ("db", "folder of the index"), ("search", "hybrid search"), ("check-duplicate", "notes that may be about the same"), ("links", "a note's links, both ways")):
        p.add_argument(f"--{flag}", help=what)
    for flag, what in (("skip-embeddings", "no new vectors"), ("stats", "counts and the last run")):
        p.add_argument(f"--{flag}", help=what, action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--limit", help="most search results", default=10, type=int)
    p.add_argument("--model", help="folder of model.onnx and tokenizer.json; without it, only lexical search")
    a = p.parse_args(argv)
    model = OnnxEmbedder(a.model) if a.model else None
    spark = SparkSession.builder.appName("loomnote").getOrCreate()
    if a.stats:
        print_stats(spark, a.vault, a.db)
    elif a.search:
        for k, r in enumerate(search_index(spark, a.search, a.vault, a.db, a.limit, model), 1):
            ranks = ", ".join(f"{n[:3]} {r[n]}" for n in ("lex_rank", "vec_rank") if r[n] is not None)
            print(f"{k}. {r['path']}:{r['start_line']} #{r['heading']} ({r['score']:.4f}; {ranks})" + (f"\n   {r['snippet']}" if r["snippet"] else ""))
    elif a.check_duplicate:
        check_duplicate(spark, a.check_duplicate, a.vault, a.db, model)
    elif a.links:
        query_links(spark, a.links, a.vault, a.db)
    else:
        build_index(spark, a.vault, a.db, a.skip_embeddings, model)
    return 0


if __name__ == "__main__":
    sys.exit(main())
