"""Session helpers that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    The zip is served by the driver through ``addPyFile``; nothing has to be installed on the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="loomnote-")
    path = os.path.join(folder, "loomnote.zip")
    Path(path).write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local, a temporary folder is made; on a cluster that is an error,
    because a machine-local folder would be lost with its machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomnote-shared-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def empty(spark: SparkSession, schema) -> DataFrame:
    """No rows and no partitions: unlike those of an empty list, nothing that a Python worker is started for."""
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)


def rows(spark: SparkSession, found: list[tuple], schema) -> DataFrame:
    """A few rows of the driver's; unlike those of a plain list, nothing that a Python worker is started for."""
    table = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in found], f.type) for k, f in enumerate(table)], schema=table), schema).coalesce(1)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back: no lineage, computed once, safe from lost executors.

    The files go when the application ends.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 32 << 20


def spread(table: DataFrame) -> DataFrame:
    """``table``, as read from files, for work that takes far longer than reading: a small one is dealt to all cores.

    A file's row group is one task, so a table of one group would be worked on by one core. Only what is smaller than
    ``SMALL`` bytes is shuffled; larger tables have their groups.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size < SMALL else table
