"""Reuse of vectors between builds, snapshots, the run log."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomnote import schemas, session


def by_id(new: DataFrame, old: DataFrame, model: str, chunking: str) -> DataFrame:
    """(id, vector) of sections whose old row has their hash, model and version, and a vector."""
    valid = reusable(old, model, chunking).select("id", "sha256", "vector")
    return new.select("id", "sha256").join(valid, ["id", "sha256"]).select("id", "vector")


def by_hash(new: DataFrame, old: DataFrame, model: str, chunking: str) -> DataFrame:
    """(id, vector) by the text's hash; equal texts have equal vectors, so any one will do.

    Hashes are matched before vectors are grouped, so those of texts that are gone aren't shuffled with their vectors.
    """
    valid = reusable(old, model, chunking).select("sha256", "vector").join(new.select("sha256").distinct(), "sha256", "left_semi")
    one = valid.groupBy("sha256").agg(F.any_value("vector").alias("vector"))
    return new.select("id", "sha256").join(one, "sha256").select("id", "vector")


def reusable(old: DataFrame, model: str, chunking: str) -> DataFrame:
    """Old rows with a vector of this model and version."""
    return old.where(F.col("vector").isNotNull() & (F.col("embedding_model") == model) & (F.col("chunking_version") == chunking))


def reuse(new: DataFrame, old: DataFrame, model: str, chunking: str) -> DataFrame:
    """``new`` with ``vector`` and ``reused``: id, hash or null where the section has to be embedded."""
    a = by_id(new, old, model, chunking).withColumnRenamed("vector", "va")
    b = by_hash(new.join(a.select("id"), "id", "left_anti"), old, model, chunking).withColumnRenamed("vector", "vb")
    rows = new.join(a, "id", "left").join(b, "id", "left")
    return rows.withColumn("vector", F.coalesce("va", "vb")).withColumn("reused", F.when(F.col("va").isNotNull(), "id").when(F.col("vb").isNotNull(), "hash")).drop("va", "vb")


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is gone."""
    return old.join(new.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones whose key isn't among them."""
    return new.unionByName(stale(old, new, key))


def replace_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


class Store:
    """Snapshots under a folder of any Hadoop file system.

    A build writes its tables to ``runs/<name>`` and then flips ``CURRENT``, a small file that names the snapshot, by
    one rename: readers see the old tables or the new ones. Vectors are appended to ``vectors`` as they are made, so a
    build that breaks off has lost none. The run log and the errors are appended to. One build writes at a time: it holds
    ``LOCK``, a file that only one can create, and renews it every ``BEAT`` seconds; others wait for ``BUSY`` seconds, and take
    over what nobody has renewed for ``ABANDONED`` seconds.
    """

    BUSY, BEAT, ABANDONED = 60.0, 30.0, 600.0

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        path = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/CURRENT", wholetext=True).first()[0])

    def exists(self) -> bool:
        return self.current() is not None

    def table(self, name: str, schema=None) -> DataFrame:
        now = self.current()
        if now is None:
            raise FileNotFoundError(self.folder)
        df = self.spark.read.parquet(f"{self.folder}/runs/{now['run']}/{name}")
        return df if schema is None else schemas.evolve(df, schema)

    def log(self, name: str, schema) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._fs.exists(self._path(path)):
            return session.empty(self.spark, schema)
        return schemas.evolve(self.spark.read.parquet(path), schema)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    @contextmanager
    def lock(self, wait: float | None = None) -> Iterator[None]:
        """Hold the writer's lock; TimeoutError if another build has it for longer than ``wait`` seconds."""
        path, until = self._path(f"{self.folder}/LOCK"), time.monotonic() + (self.BUSY if wait is None else wait)
        self._fs.mkdirs(self._path(self.folder))
        while not self._created(path):
            if self._fs.exists(path) and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > self.ABANDONED:
                self._fs.delete(path, False)
            elif time.monotonic() > until:
                raise TimeoutError(f"another build writes to {self.folder}, or one broke off less than {self.ABANDONED:.0f} seconds ago")
            else:
                time.sleep(min(1.0, max(0.0, until - time.monotonic()) + 0.01))
        done = threading.Event()

        def renew() -> None:
            while not done.wait(self.BEAT):
                self._fs.create(path, True).close()

        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        try:
            yield
        finally:
            done.set()
            beat.join()
            self._fs.delete(path, False)

    def _created(self, path) -> bool:
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError:  # it exists
            if not self._fs.exists(path):
                raise
            return False
        return True

    def compact(self, name: str, keys: list[str], files: int = 200) -> None:
        """Write a log anew, one row for each of ``keys``, once it has more than ``files`` files. Only under the lock."""
        at, new, old = (self._path(f"{self.folder}/{name}{suffix}") for suffix in ("", ".new", ".old"))
        if self._fs.exists(old) and not self._fs.exists(at):  # a compaction broke off between its renames
            self._fs.rename(old, at)
        for rest in (new, old):
            self._fs.delete(rest, True)
        if not self._fs.exists(at) or self._fs.getContentSummary(at).getFileCount() <= files:
            return
        self.spark.read.parquet(at.toString()).dropDuplicates(keys).write.parquet(new.toString())
        self._fs.rename(at, old)
        self._fs.rename(new, at)
        self._fs.delete(old, True)

    def meta(self) -> DataFrame:
        """(key, value) of the current snapshot and of what was put."""
        rows = (self.current() or {}) | {r.key: r.value for r in self.log("meta", schemas.META).collect()}
        return session.rows(self.spark, [(k, str(v)) for k, v in rows.items()], schemas.META)

    def put(self, values: dict[str, str]) -> None:
        """Upsert keys of ``meta``. Only under the lock."""
        old = {r.key: r.value for r in self.log("meta", schemas.META).collect()}
        rows = [(k, str(v)) for k, v in (old | values).items()]
        session.rows(self.spark, rows, schemas.META).write.mode("overwrite").parquet(f"{self.folder}/meta")

    def new_run(self) -> str:
        return uuid.uuid4().hex

    def home(self, run: str) -> str:
        return f"{self.folder}/runs/{run}"

    def place(self, run: str, name: str) -> str:
        return f"{self.home(run)}/{name}"

    def write(self, run: str, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(self.place(run, name))
        return self.spark.read.parquet(self.place(run, name))

    def drop(self, run: str, name: str) -> None:
        """Remove a table that the snapshot was made from."""
        self._fs.delete(self._path(self.place(run, name)), True)

    def commit(self, run: str, **more) -> None:
        temp, final = self._path(f"{self.folder}/.CURRENT.{run}"), self._path(f"{self.folder}/CURRENT")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"run": run, "schema_version": schemas.SCHEMA_VERSION, **more}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self.spark._jvm.org.apache.hadoop.fs.Options, "Rename")
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context.rename(temp, final, overwrite)

    def prune(self, keep: set[str]) -> None:
        """Remove the snapshots that aren't among ``keep``: the current one, and the last, which may still be read."""
        root = self._path(f"{self.folder}/runs")
        for s in self._fs.listStatus(root):
            if s.getPath().getName() not in keep:
                self._fs.delete(s.getPath(), True)

    def size(self) -> int:
        """Bytes under the folder."""
        return self._fs.getContentSummary(self._path(self.folder)).getLength()


def statistics(notes: DataFrame, sections: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: notes, sections, vectors, edges."""
    return notes.agg(F.count("*").alias("notes")).crossJoin(sections.agg(F.count("*").alias("sections"), F.count("vector").alias("vectors"))).crossJoin(edges.agg(F.count("*").alias("edges")))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("id").desc()).limit(1)
