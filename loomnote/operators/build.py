"""A build's one pass over the notes: each range of paths becomes a file of parsed notes, one of sections, one of postings, one
of the keys that links are resolved by. A second pass makes edges of them, a file a range."""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomnote import schemas
from loomnote.functions import parse
from loomnote.functions import text as X
from loomnote.operators import notes, search
from loomnote.sources import vault

PER_TASK = 2000
COUNTS = ("docs", "tokens", "vectors", "links", "errors", "carried")  # sections, their tokens and vectors, links, notes that failed, ranges taken over
_SECTIONS = to_arrow_schema(schemas.SECTIONS)
_PARSED = pa.schema([("path", pa.string()), ("digest", pa.string()), ("note", notes.NOTE), ("links", pa.list_(notes.LINK)), ("error", pa.string())])
_KEYS = pa.schema([("key", pa.string()), ("path", pa.string())])  # what a note can be found by; without a path, what a link of the range looks for
_AS_PATH, _BY_NAME = "p", "n"  # a key begins with what it is
_EDGES = to_arrow_schema(schemas.EDGES)
_RANGES = pa.schema([("path", pa.string()), ("before", pa.int32())])


def version() -> str:
    """Changes with the code and the settings that a section, a posting or a parsed note depends on."""
    said = [schemas.SCHEMA_VERSION, schemas.MODEL, schemas.CHUNKING, unicodedata.unidata_version, str(_SECTIONS), str(_PARSED), str(_KEYS)]
    return hashlib.sha256("\n".join([*said, *(module.__loader__.get_source(module.__name__) for module in (parse, X, notes, search)), __loader__.get_source(__name__)]).encode()).hexdigest()


def deal(names: list[str], cores: int, before: list[str] | None = None, per_task: int = PER_TASK) -> list[tuple[list[str], int | None]]:
    """The sorted ``names`` in ranges, each with the number of the range before that had its place.

    ``before`` has the first names of the last build's ranges, which stay as they are. One that has grown to more than two
    tasks' names is cut anew; where too few are left for the cores, all are.
    """
    n = len(names)
    tasks = max(-(-n // per_task), min(2 * cores, -(-n // 100)))
    if before:
        at = [0, *(bisect_left(names, x) for x in before[1:]), n]
        found = [(names[a:b], k) for k, (a, b) in enumerate(zip(at, at[1:])) if a < b]
        if 2 * len(found) >= tasks:
            return [x for part, k in found for x in ([(part, k)] if len(part) <= 2 * per_task else [(p, None) for p in _even(part, -(-len(part) // per_task))])]
    return [(part, None) for part in _even(names, tasks)]


def _even(names: list[str], parts: int) -> list[list[str]]:
    return [names[k * len(names) // parts : (k + 1) * len(names) // parts] for k in range(parts)]


def first_names(run: str, of: str) -> list[str] | None:
    """The first name of each range of a snapshot whose ranges were made by ``of``, or None."""
    with vault.parquet(f"{run}/ranges/ranges.parquet") as f:
        if f is None or f.schema_arrow.metadata.get(b"version") != of.encode():
            return None
        return [f.read_row_group(k, ["path"])["path"][0].as_py() for k in range(f.num_row_groups)]


def scan(spark: SparkSession, base: str, run: str, before: str | None, sections: str, fill: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None, carry: bool) -> dict[str, int]:
    """Write ``parsed``, ``keys``, ``sections`` (under that name) and ``sections_postings`` of all notes below ``base`` to ``run``.

    Names are listed on the driver and dealt in ranges. A task reads its notes, and where there is a snapshot ``before`` whose
    range has the same names and, by their hashes, the same contents, it takes over what was made of them; everything else
    is parsed. Nothing is shuffled, and texts never leave their Python worker. ``fill`` gives sections their vectors;
    without ``carry`` the next build can't take over, as ``sections`` isn't what stays. Returns ``COUNTS``.
    """
    made_by = version()
    ranges = deal(sorted(vault.note_paths(base)), spark.sparkContext.defaultParallelism, first_names(before, made_by) if before and carry else None)
    places = {"parsed": _PARSED, "keys": _KEYS, sections: _SECTIONS, "sections_postings": search.plain_postings(pa.string())}
    for name, schema in places.items():
        vault.write_table(f"{run}/{name}", schema.empty_table())  # there may be no task at all
    tables = (pa.table([part, [k] * len(part)], schema=_RANGES) for part, k in ranges)
    vault.write_groups(f"{run}/ranges/ranges.parquet", _RANGES.with_metadata({"version": made_by if carry else ""}), tables)
    if not ranges:
        return dict.fromkeys(COUNTS, 0)
    read = vault.reader(base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            with vault.parquet(f"{run}/ranges/ranges.parquet") as f:
                mine = f.read_row_group(k)
            names, old = mine["path"].to_pylist(), mine["before"][0].as_py()
            count = dict.fromkeys(COUNTS, 0)
            if old is not None and (counted := _same(f"{before}/parsed", old, names, read)) is not None:
                count |= counted | {"vectors": 0, "carried": 1}
                for name in ("parsed", "keys", "sections_postings", *([] if fill else [sections])):
                    vault.copy_part(f"{before}/{name}", old, f"{run}/{name}", k)
                if fill:
                    _filled(f"{before}/{sections}", old, vault.Part(f"{run}/{sections}", _SECTIONS, k, **search.SECTION_FILE), fill, count)
            else:
                parsed, rows = vault.Part(f"{run}/parsed", _PARSED, k, store_schema=False), vault.Part(f"{run}/{sections}", _SECTIONS, k, **search.SECTION_FILE)
                found = vault.Part(f"{run}/sections_postings", search.coded_postings(pa.string()), k, **search.POSTINGS_FILE)
                keys = vault.Part(f"{run}/keys", _KEYS, k, store_schema=False)
                batches_of = _parsed(names, read, parsed, keys, count)
                search.index_groups(fill(batches_of) if fill else batches_of, "id", "text", found, rows, _SECTIONS, count)
                parsed.close({n: str(count[n]) for n in COUNTS})
                for part in (keys, found, rows):
                    part.close()
            yield pa.RecordBatch.from_arrays([pa.array([count[n]]) for n in COUNTS], names=list(COUNTS))

    done = spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(work, ", ".join(f"{n} long" for n in COUNTS))
    return done.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS)).collect()[0].asDict()


def _same(folder: str, k: int, names: list[str], read: Callable[[Iterable[str]], Iterator[bytes | None]]) -> dict[str, int] | None:
    """The counts of a range whose notes are as they were; None if one isn't, or was never read."""
    with vault.parquet(vault.part_name(folder, k)) as f:
        if f is None:
            return None
        kept, said = f.read(["path", "digest"]), f.metadata.metadata
        if kept["path"].to_pylist() != names or not all(d is not None and _digest(raw) == d for d, raw in zip(kept["digest"].to_pylist(), read(names))):
            return None
        return {n: int(said[n.encode()]) for n in COUNTS}


def _digest(raw: bytes | None) -> str | None:
    return None if raw is None else hashlib.sha256(raw).hexdigest()


def _filled(folder: str, k: int, rows: vault.Part, fill: Callable, count: dict[str, int]) -> None:
    """The sections of a range that hasn't changed, with vectors."""
    with vault.parquet(vault.part_name(folder, k)) as f:
        for group in search.groups(fill(b.cast(_SECTIONS) for b in f.iter_batches(search.GROUP))):
            part = pa.Table.from_batches(group)
            rows.write(part)
            count["vectors"] += part.num_rows - part["vector"].null_count
    rows.close()


def _parsed(names: list[str], read: Callable[[Iterable[str]], Iterator[bytes | None]], parsed: vault.Part, keys: vault.Part, count: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The sections of some notes, without vectors, in batches of bounded size; what else is in the notes goes to ``parsed`` and ``keys``."""
    rows, digests, size, kept, wanted = [], [], 0, [], set()

    def flush() -> pa.RecordBatch:
        path, note, chunks, links, error = zip(*rows)
        kept.append(pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(digests, pa.string()), notes.structs(note, notes.NOTE), notes.lists(links, notes.LINK), pa.array(error, pa.string())], schema=_PARSED))
        count["links"] += sum(map(len, links))
        count["errors"] += sum(e is not None for e in error)
        own = [p for p, n in zip(path, note) if n is not None]
        keys.write(pa.table([[_AS_PATH + X.fold_key(p) for p in own] + [_BY_NAME + X.stem_key(p) for p in own], own + own], schema=_KEYS))
        for p, found in zip(path, links):
            folder = X.folder_of(p)
            wanted.update(key for target, _ in found for key in _lookups(target, folder))
        if len(wanted) > 1 << 20:
            looked_for()
        if sum(b.nbytes for b in kept) > 1 << 25:
            parsed.write(pa.Table.from_batches(kept))
            kept.clear()
        return _sections(path, chunks)

    def looked_for() -> None:
        keys.write(pa.table([sorted(wanted), pa.nulls(len(wanted), pa.string())], schema=_KEYS))
        wanted.clear()

    for path, raw in zip(names, read(names)):
        rows.append(notes.parsed(path, raw))
        digests.append(_digest(raw))
        size += len(raw or b"")
        if len(rows) == 256 or size > 4_000_000:
            yield flush()
            rows, digests, size = [], [], 0
    if rows:
        yield flush()
    if kept:
        parsed.write(pa.Table.from_batches(kept))
    looked_for()


def _lookups(target: str, folder: str) -> list[str]:
    """A link's keys, the first that a note has counts."""
    path, beside, name = X.link_keys(target, folder)
    return [kind + key for kind, key in ((_AS_PATH, path), (_AS_PATH, beside), (_BY_NAME, name)) if key is not None]


def edges(spark: SparkSession, run: str, before: str | None = None) -> int:
    """Write ``edges`` of a scan to ``run``, a file a range; returns their number.

    The edges are those of ``graph.resolve``, once for each source, target and line. What is shuffled is a row for each key that
    a range looks for, however many of its links have it, and what was found goes back to the range by its number. A range whose
    notes and finds are those of the snapshot ``before`` takes over its edges.
    """
    vault.write_table(f"{run}/edges", _EDGES.empty_table())
    with vault.parquet(f"{run}/ranges/ranges.parquet") as f:
        ranges = f.num_row_groups
    if not ranges:
        return 0
    made_by = version()
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("int").alias("range")
    keys = spark.read.schema("key string, path string").parquet(f"{run}/keys").select("key", "path", number)
    have = keys.where("path is not null").groupBy("key").agg(F.count("*").alias("n"), F.max_by("path", F.split("path", "/")).alias("path"))
    have = have.where(F.col("key").startswith(_AS_PATH) | (F.col("n") == 1)).drop("n")  # the last path of a key; of names, those that only one note has
    found = keys.where("path is null").select("key", "range").join(have, "key").select("range", "key", "path")
    every = spark.range(0, ranges, 1, 1).select(F.col("id").cast("int").alias("range"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("path"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, dict[str, str]] = defaultdict(dict)
        for b in batches:
            for k, key, path in zip(*(c.to_pylist() for c in b.columns)):
                of[k][key] = path
        for k, to in of.items():
            mark = _mark(f"{run}/parsed", k, made_by, to)
            with vault.parquet(f"{run}/ranges/ranges.parquet") as f:
                old = f.read_row_group(k, ["before"])["before"][0].as_py()
            if before and old is not None and (n := _marked(f"{before}/edges", old, mark)) is not None:
                vault.copy_part(f"{before}/edges", old, f"{run}/edges", k)
                yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])
                continue
            out, n = vault.Part(f"{run}/edges", _EDGES, k, store_schema=False), 0
            with vault.parquet(vault.part_name(f"{run}/parsed", k)) as f:
                for batch in f.iter_batches(1000, columns=["path", "links"]):
                    rows = [(p, t, next((to[x] for x in _lookups(t, folder) if x in to), None), line) for p, folder, t, line in _links(batch)]
                    out.write(pa.table([pa.array(c, field.type) for c, field in zip(zip(*rows), _EDGES)], schema=_EDGES) if rows else _EDGES.empty_table())
                    n += len(rows)
            out.close({"made_of": mark, "edges": str(n)})
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return found.unionByName(every).repartitionById(ranges, F.col("range")).mapInArrow(resolve, "n long").agg(F.sum("n")).collect()[0][0]


def _mark(folder: str, k: int, made_by: str, to: dict[str | None, str]) -> str:
    """A hash of all that a range's edges depend on."""
    to.pop(None, None)  # of the row that each range has
    with vault.parquet(vault.part_name(folder, k)) as f:
        notes_of = f.read(["path", "digest"])
    return hashlib.sha256(repr((made_by, *(c.to_pylist() for c in notes_of.columns), sorted(to.items()))).encode("utf-8", "surrogatepass")).hexdigest()


def _marked(folder: str, k: int, mark: str) -> int | None:
    """How many edges a part has; None where it wasn't made of the same."""
    with vault.parquet(vault.part_name(folder, k)) as f:
        said = f and f.metadata.metadata or {}
    return int(said[b"edges"]) if said.get(b"made_of") == mark.encode() else None


def _links(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str, int]]:
    """(path, folder, raw target, line) of the links of parsed notes, each once."""
    targets, lines = (c.to_pylist() for c in batch["links"].flatten().flatten())
    at = 0
    for path, n in zip(batch["path"].to_pylist(), batch["links"].value_lengths().to_pylist()):
        folder = X.folder_of(path)
        for target, line in dict.fromkeys(zip(targets[at : at + n], lines[at : at + n])):
            yield path, folder, target, line
        at += n


def _sections(paths: Iterable[str], chunks: Iterable[list[tuple]]) -> pa.RecordBatch:
    found = [(f"{p}::{ordinal}:{index}", p, heading, line, index, sha256, text) for p, own in zip(paths, chunks) for ordinal, index, heading, line, sha256, text in own]
    columns = dict(zip(("id", "path", "heading", "start_line", "chunk_index", "sha256", "text"), zip(*found) if found else [()] * 7))
    n = len(found)
    arrays = {"embedding_model": pa.repeat(schemas.MODEL, n), "chunking_version": pa.repeat(schemas.CHUNKING, n), "vector": pa.nulls(n, _SECTIONS.field("vector").type)}
    arrays |= {c: pa.array(x, _SECTIONS.field(c).type) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([arrays[c] for c in _SECTIONS.names], schema=_SECTIONS)
