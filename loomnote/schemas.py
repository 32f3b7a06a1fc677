"""Declared schemas of the index tables, and additive evolution of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "2"
MODEL = "BAAI/bge-small-en-v1.5"
DIMENSIONS = 384
CHUNKING = "heading-estimate-v1"

_TYPES = {"string": T.StringType(), "binary": T.BinaryType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def struct(columns: str) -> T.StructType:
    """A schema of "name type, ..."; made without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


FILES = struct("path string, content binary")
NOTES = struct("path string, filename string, category string, energy int, sentiment double, sentiment_labels array<string>, tags array<string>, summary_snippet string, word_count int")
SECTIONS = struct("id string, path string, heading string, start_line int, chunk_index int, sha256 string, embedding_model string, chunking_version string, vector array<float>, text string")
EDGES = struct("source_path string, raw_target string, resolved_target_path string, start_line int")
STATS = struct("docs long, tokens long")
RUNS = struct("id long, started_at timestamp, completed_at timestamp, vault_path string, status string, note_count long, section_count long, embedding_count long, error_count long")
ERRORS = struct("run_id long, path string, stage string, message string")
META = struct("key string, value string")
RESULT = struct("path string, heading string, start_line int, score double, lex_rank int, vec_rank int, raw_sim double, snippet string")
LINK_EVENTS = struct("commit_sha string, date string, source string, target string, event string")
DELETED_CHUNKS = struct("sha string, date string, author string, path string, text string, vector array<float>")
CALL = struct("calendarName string, contact string, start string, end string, durationSeconds double, direction string, source string")


def evolve(df: DataFrame, schema: T.StructType | str, required: set[str] = frozenset()) -> DataFrame | None:
    """``df`` with the columns of ``schema``: missing ones are added as null, further ones go.

    None where a required column is missing, which means that the table has to be made anew.
    """
    schema = struct(schema) if isinstance(schema, str) else schema
    if not set(required) <= set(df.columns):
        return None
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
