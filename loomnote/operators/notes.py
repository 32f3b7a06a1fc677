"""Notes parsed in one pass over the files: notes, section chunks, links and errors."""

from __future__ import annotations

import itertools
from collections.abc import Collection, Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomnote.functions import parse
from loomnote.functions import text as X

PARSED = """path string,
note struct<energy: int, sentiment: double, sentiment_labels: array<string>, tags: array<string>, summary_snippet: string, word_count: int>,
chunks array<struct<ordinal: int, chunk_index: int, heading: string, start_line: int, sha256: string, text: string>>,
links array<struct<raw_target: string, start_line: int>>, error string"""


PARTS = ("note", "chunks", "links")
LINK, _CHUNK = pa.struct([("raw_target", pa.string()), ("start_line", pa.int32())]), pa.struct([("ordinal", pa.int32()), ("chunk_index", pa.int32()), ("heading", pa.string()), ("start_line", pa.int32()), ("sha256", pa.string()), ("text", pa.string())])
NOTE = pa.struct([("energy", pa.int32()), ("sentiment", pa.float64()), ("sentiment_labels", pa.list_(pa.string())), ("tags", pa.list_(pa.string())), ("summary_snippet", pa.string()), ("word_count", pa.int32())])


def parsed(path: str, raw: bytes | None, parts: Collection[str] = PARTS) -> tuple:
    """What could be read before an error stays, as a failing note keeps its row."""
    note, chunks, links, error = None, [], [], None
    try:
        if raw is None:
            raise OSError("the file can't be read")
        content = parse.text_of(raw)
        f = parse.front(content)
        if "note" in parts:
            energy = f.energy if f.energy is None or f.energy < 1 << 31 else None
            note = energy, f.sentiment, f.labels, f.tags, parse.key_lines(f.body), parse.word_count(f.body)
        if "links" in parts:
            links = parse.links(content)
        if "chunks" in parts:
            for c in parse.chunks(PurePosixPath(path).stem, f.body, f.line):
                chunks.append((c.ordinal, c.index, c.heading, c.line, c.sha256, c.text))
    except Exception as e:  # one bad file mustn't end the build; the reason is kept
        error = str(e) or type(e).__name__
    return path, note, chunks, links, error


def structs(rows: Sequence[tuple | None], kind: pa.StructType) -> pa.StructArray:
    columns = zip(*(r or (None,) * len(kind) for r in rows)) if rows else ([] for _ in kind)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind), mask=pa.array([r is None for r in rows], pa.bool_()))


def lists(rows: Sequence[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    ends = pa.array(itertools.accumulate(map(len, rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, structs([x for r in rows for x in r], kind))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    path, note, chunks, links, error = zip(*rows)
    arrays = [pa.array(path, pa.string()), structs(note, NOTE), lists(chunks, _CHUNK), lists(links, LINK), pa.array(error, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "note", "chunks", "links", "error"])


def parse_files(files: DataFrame, parts: Collection[str] = PARTS) -> DataFrame:
    """``files`` (path, content) parsed; persist the result, as several tables come from it.

    Only ``parts`` are made, the others stay null or empty. Columns are built as Arrow arrays, and a batch ends at 256 notes
    or 4 million characters, whichever is first, so a worker holds no more than that of the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = content.as_py()
                rows.append(parsed(path, raw, parts))
                size += len(raw or b"")
                if len(rows) == 256 or size > 4_000_000:
                    yield _record(rows)
                    rows, size = [], 0
            if rows:
                yield _record(rows)

    return files.select("path", "content").mapInArrow(run, PARSED)


def notes(parsed: DataFrame) -> DataFrame:
    return parsed.where("note is not null").select("path", F.substring_index("path", "/", -1).alias("filename"), X.category(F.col("path")).alias("category"), "note.*")


def sections(parsed: DataFrame) -> DataFrame:
    """One row a chunk, without vectors; ids are positional: path::section:chunk."""
    rows = parsed.select("path", F.explode("chunks").alias("c"))
    return rows.select(F.concat("path", F.lit("::"), "c.ordinal", F.lit(":"), "c.chunk_index").alias("id"), "path", "c.heading", "c.start_line", "c.chunk_index", "c.sha256", "c.text")


def raw_links(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("source_path"), F.explode("links").alias("k")).select("source_path", "k.raw_target", "k.start_line")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("path", F.lit("parse").alias("stage"), F.col("error").alias("message"))


def split_sections(lines: DataFrame, doc: str, n: str, line: str, is_heading) -> DataFrame:
    """The same split on rows of lines, by windows: (doc, section, first, last) of the runs that headings begin.

    ``last`` is the place before the next heading, or the text's last line.
    """
    own = Window.partitionBy(doc).orderBy(n)
    heads = lines.withColumn("head", is_heading(F.col(line)).cast("int")).withColumn("section", F.sum("head").over(own))
    return heads.groupBy(doc, "section").agg(F.min(n).alias("first"), F.max(n).alias("last"))


def read_section(sections: DataFrame, path: str, heading: str) -> DataFrame:
    """The chunks of a note's section, in order; both filters reach the scan."""
    return sections.where((F.col("path") == path) & (F.col("heading") == heading)).orderBy("start_line", "chunk_index")
