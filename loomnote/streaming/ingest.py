"""Structured Streaming: notes as files that arrive, and calls as lines of JSON (extensions; the batch forms are the rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomnote import session
from loomnote.operators import events, lifecycle, notes
from loomnote.sources import vault


# Spark lists the files of each batch again in up to 10,000 tasks, and reads 32 files of 4 MB (as it counts a small one) in a task.
SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "32", "spark.sql.files.openCostInBytes": "131072"}


def note_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, content, seen) of notes as they appear in ``folder``; hidden files are left out by Spark.

    The stream has a session of its own, so its settings for many small files concern nothing else.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in SMALL_FILES.items():
        own.conf.set(k, v)
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = own.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content", F.col("modificationTime").alias("seen"))


def ingest(stream: DataFrame, store: lifecycle.Store, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived, and append notes and sections, each batch once, then stop."""

    def batch(rows: DataFrame, number: int) -> None:
        parsed = session.cut(notes.parse_files(rows.select("path", "content")))
        for name, table in (("notes", notes.notes(parsed)), ("sections", notes.sections(parsed))):
            table.write.mode("overwrite").parquet(f"{store.folder}/stream/{name}/batch={number}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_notes(spark: SparkSession, store: lifecycle.Store) -> DataFrame:
    """The last batch's row of each note."""
    return lifecycle.replace_latest(spark.read.parquet(f"{store.folder}/stream/notes"), "path", "batch").drop("batch")


def call_stream(spark: SparkSession, folder: str, checkpoint: str, out: str) -> StreamingQuery:
    """Calendar events from files of JSON lines; appended exactly once by the Parquet sink."""
    bodies = spark.readStream.text(folder).select(vault.call_events(F.col("value")).alias("call"))
    return events.responses(events.calls(bodies)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and window, final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
