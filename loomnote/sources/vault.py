"""Notes and other files as DataFrames."""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomnote import schemas

PRUNED = frozenset("__pycache__ .git .obsidian .trash .venv node_modules".split())


def find_root(start: str | os.PathLike | None = None) -> Path:
    """The nearest folder, from ``start`` up, that has .obsidian or .git; else ``start``."""
    here = Path(start or Path.cwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / ".obsidian").exists() or (p / ".git").exists()), here)


_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a local folder or of a URI (file, hdfs, s3, gs), whose path isn't escaped."""
    m = _URI.fullmatch(uri)
    if not m or m[1] == "file":
        return pafs.LocalFileSystem(), m[3] if m else os.path.abspath(uri)
    where, base = pafs.FileSystem.from_uri(f"{m[1]}://{m[2] or ''}/")
    return where, base.rstrip("/") + m[3]


def _entries(where: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool]]:
    """(path, name, whether it is a folder) of what is in a folder; nothing where there is none."""
    for x in where.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if x.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield x.path, x.base_name, x.type == pafs.FileType.Directory


def _local_entries(folder: str) -> Iterator[tuple[str, str, bool]]:
    """``_entries`` of a local folder, without asking for each file's size and time."""
    try:
        with os.scandir(folder or "/") as found:
            for x in found:
                if (is_folder := x.is_dir()) or x.is_file():
                    yield f"{folder}/{x.name}", x.name, is_folder
    except FileNotFoundError:
        return


def note_paths(root: str | os.PathLike) -> list[str]:
    """Relative paths of the ``.md`` files, hidden ones too, in order of their components."""
    where, base = _open(str(root))
    base = base.rstrip("/")
    entries, found, todo = _local_entries if isinstance(where, pafs.LocalFileSystem) else functools.partial(_entries, where), [], [base]
    while todo:
        for path, name, folder in entries(todo.pop()):
            if folder:
                if name not in PRUNED:
                    todo.append(path)
            elif name.endswith(".md"):
                found.append(path[len(base) + 1 :])
    return sorted(found, key=lambda p: p.split("/"))


def reader(root: str | os.PathLike) -> Callable[[Iterable[str]], Iterator[bytes | None]]:
    """A function for the tasks, which need to reach ``root``: the contents of paths below it, None where one can't be read."""
    base = str(root) if "://" in str(root) or str(root).startswith("file:") else str(Path(root).resolve())

    def read(paths: Iterable[str]) -> Iterator[bytes | None]:
        where, top = _open(base)
        for p in paths:
            yield _bytes(where, f"{top.rstrip('/')}/{p}")

    return read


def read_notes(spark: SparkSession, root: str | os.PathLike, per_task: int = 500) -> DataFrame:
    """(path, content) of every note under a folder, local or of an object store; contents are read by the tasks.

    Names are listed on the driver (Spark's file sources skip hidden files).
    """
    names, read = note_paths(root), reader(root)
    if not names:
        return spark.createDataFrame([], schemas.FILES)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 100):
                part = b.path.iloc[k : k + 100]
                yield pd.DataFrame({"path": part, "content": list(read(part))})

    tasks = max(-(-len(names) // per_task), min(2 * spark.sparkContext.defaultParallelism, -(-len(names) // 100)))
    return spark.createDataFrame(pa.table({"path": pa.array(names, pa.string())})).repartitionByRange(tasks, "path").mapInPandas(load, schemas.FILES)


def _bytes(where: pafs.FileSystem, path: str) -> bytes | None:
    try:
        with open(path, "rb") if isinstance(where, pafs.LocalFileSystem) else where.open_input_file(path) as f:
            return f.read()
    except OSError:
        return None  # the parser makes an error row of it


def write_file(uri: str, content: bytes) -> None:
    where, path = _open(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as f:
        f.write(content)


def write_files(root: str, files: Iterable[tuple[str, bytes]]) -> int:
    """Write (path below ``root``, content); each folder is made once. Returns their number."""
    (where, base), made, n = _open(root), set(), 0
    for path, content in files:
        folder = f"{base}/{path}".rsplit("/", 1)[0]
        if folder not in made:
            where.create_dir(folder, recursive=True)
            made.add(folder)
        with open(f"{base}/{path}", "wb") if isinstance(where, pafs.LocalFileSystem) else where.open_output_stream(f"{base}/{path}") as f:
            f.write(content)
        n += 1
    return n


def part_name(folder: str, k: int) -> str:
    return f"{folder}/part-{k:06d}.parquet"


class Part:
    """A task's file in a folder of Parquet files, hidden until it is whole.

    Its name is a number, that of the partition unless another is given, so a task that is run again replaces what it wrote
    before, and no row is there twice.
    """

    def __init__(self, folder: str, schema: pa.Schema, number: int | None = None, **options):
        self._where, at = _open(folder)
        self._where.create_dir(at, recursive=True)
        self._hidden, self._final = f"{at}/.{uuid.uuid4().hex}", part_name(at, TaskContext.get().partitionId() if number is None else number)
        self._out = self._where.open_output_stream(self._hidden)
        self._rows = pq.ParquetWriter(self._out, schema, **options)

    def write(self, rows: pa.Table) -> None:
        """One row group."""
        if rows.num_rows:
            self._rows.write_table(rows, row_group_size=rows.num_rows)

    def close(self, said: dict[str, str] | None = None) -> None:
        """``said`` is kept in the file's metadata."""
        if said:
            self._rows.add_key_value_metadata(said)
        self._rows.close()
        self._out.close()
        _move(self._where, self._hidden, self._final)


def _move(where: pafs.FileSystem, hidden: str, final: str) -> None:
    try:
        where.move(hidden, final)
    except OSError:  # a file system that doesn't replace
        where.delete_file(final)
        where.move(hidden, final)


def copy_part(folder: str, k: int, to: str, number: int) -> None:
    """Another folder's part, as it is. A local file is only linked: parts are replaced, never written to."""
    (where, source), (_, at) = _open(part_name(folder, k)), _open(to)
    hidden = f"{at}/.{uuid.uuid4().hex}"
    try:
        if not isinstance(where, pafs.LocalFileSystem):
            raise OSError("only local files have links")
        os.link(source, hidden)
    except OSError:
        where.copy_file(source, hidden)
    _move(where, hidden, part_name(at, number))


@contextmanager
def parquet(uri: str) -> Iterator[pq.ParquetFile | None]:
    """A Parquet file; None where there is none."""
    where, path = _open(uri)
    if where.get_file_info(path).type != pafs.FileType.File:
        yield None
        return
    with where.open_input_file(path) as f:
        yield pq.ParquetFile(f)


def write_groups(uri: str, schema: pa.Schema, groups: Iterable[pa.Table]) -> None:
    """One Parquet file, a row group for each table."""
    where, path = _open(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as f, pq.ParquetWriter(f, schema) as out:
        for g in groups:
            out.write_table(g.cast(schema), row_group_size=max(1, g.num_rows))


def write_table(folder: str, rows: pa.Table, **options) -> None:
    """Add ``rows`` to a folder of Parquet files, from a task: written under a hidden name, then renamed."""
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with where.open_output_stream(f"{path}/.{name}") as f:
        pq.write_table(rows, f, **options)
    where.move(f"{path}/.{name}", f"{path}/task-{name}.parquet")


def changed_files(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose MD5 isn't the cached one (path, md5): those that need work."""
    now = files.withColumn("md5", F.md5("content"))
    return now.join(cached.select("path", "md5"), ["path", "md5"], "left_anti")


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path`` in ``schema``; empty where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return schemas.evolve(df, schema)


def latest_files(spark: SparkSession, path: str, n: int, pattern: str = "*.jsonl") -> DataFrame:
    """(path, modificationTime, length) of the files that changed last; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "modificationTime", "length").orderBy(F.col("modificationTime").desc(), "path").limit(n)


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of ``git log -p`` output; one task a file, in the file's order (a log is a sequence)."""

    def number(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            for file, text in zip(b.path, b.content):
                lines = bytes(text).decode("utf-8", "ignore").split("\n")
                lines = lines[:-1] if lines and lines[-1] == "" else lines
                for k in range(0, len(lines), 50_000):
                    part = lines[k : k + 50_000]
                    yield pd.DataFrame({"file": file, "n": range(k, k + len(part)), "line": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(number, "file string, n long, line string")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the assistant's text blocks in JSONL transcripts, each once, thinking left out."""
    shape = "role string, message struct<id: string>, content array<struct<type: string, text: string>>"
    lines = spark.read.schema(shape).json(path).where("role = 'assistant'")
    blocks = lines.select(F.col("message.id").alias("id"), F.explode("content").alias("block")).where("block.type = 'text'")
    return blocks.select("id", F.coalesce("block.text", F.lit("")).alias("text")).dropDuplicates(["id", "text"])


def call_events(body: Column) -> Column:
    """A webhook's JSON body as a struct of ``schemas.CALL``; null or bad JSON gives null fields."""
    return F.from_json(F.coalesce(body, F.lit("{}")), schemas.CALL)
