"""Media columns: binary payloads kept in ZIP archives, written and read in parallel.

``write_archives`` puts a binary or string column into archives, one for each task, under the shared folder. A task
writes to a name of its own attempt and moves the finished file to the task's name, unless an attempt before it has
done so; attempts that are repeated or lost leave one whole archive.

``ArchiveSource`` (format ``members``) reads folders of such archives. The driver only lists files and sizes and plans
byte ranges of about ``split`` bytes; it opens none. A task reads the archive's own directory at its end (ZIP64 too)
and takes the members whose header begins in its range, so each member is read exactly once. Payloads stream out in
Arrow batches of about ``batch`` bytes. A member that can't be read, or whose length or CRC-32 is wrong, is tried
again by itself, from its offset and through a newly opened file, ``retries`` times; after that its row has a null
payload and the reason in ``error``, and the other members go on. An archive whose directory can't be read gives one
such row, with null member, from the range that holds its start.

Members may be stored or deflated. A member that unpacks to more bytes than its directory names, or to more than a
binary value can hold (2 GiB), is an error row too, found without unpacking further.

Rows: a member's name is ``id/number`` and a mark, ``!`` for a null id, ``?`` for a null payload; the id is what comes
before the last slash, so ids may be empty, hold slashes or any character, and repeat (up to 60,000 bytes; beyond that
writing fails with a message, as the format's names end there). Empty payloads come back empty, null ones null; very
long ones, up to 2 GiB, whole. Empty tables give no archive and no rows. Only the id and the payload are read, so extra
columns with the names of results are safe.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
BATCH = 4 << 20
RETRIES = 3
LARGEST = (1 << 31) - 1
LONGEST_ID = 60_000
SCHEMA = "archive string, member string, offset long, size long, payload binary, error string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int, length: int):
        super().__init__(None)
        self.archive, self.start, self.end, self.length = archive, start, end, length


class Member:
    __slots__ = ("name", "offset", "method", "packed", "size", "crc")

    def __init__(self, name: str, offset: int, method: int, packed: int, size: int, crc: int):
        self.name, self.offset, self.method, self.packed, self.size, self.crc = name, offset, method, packed, size, crc


def directory(f, length: int) -> list[Member]:
    """The members that the archive's directory names, by offset."""
    tail = min(length, 65557 + 20)
    f.seek(length - tail)
    data = f.read(tail)
    k = data.rfind(b"PK\x05\x06")
    if k < 0 or len(data) < k + 22:
        raise ValueError("no directory at the archive's end")
    count, size, at = struct.unpack_from("<HII", data, k + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        if k < 20 or data[k - 20 : k - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", data, k - 12)[0])
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory record")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
    f.seek(at)
    data, k, out = f.read(size), 0, []
    for _ in range(count):
        if data[k : k + 4] != b"PK\x01\x02":
            raise ValueError("the archive's directory is broken")
        flags, method = struct.unpack_from("<HH", data, k + 8)
        crc, packed, plain, n, extra, note = struct.unpack_from("<IIIHHH", data, k + 16)
        offset = struct.unpack_from("<I", data, k + 42)[0]
        name = data[k + 46 : k + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        e, stop = k + 46 + n, k + 46 + n + extra
        while e + 4 <= stop:
            kind, m = struct.unpack_from("<HH", data, e)
            if kind == 1:
                p = e + 4
                if plain == 0xFFFFFFFF:
                    plain, p = struct.unpack_from("<Q", data, p)[0], p + 8
                if packed == 0xFFFFFFFF:
                    packed, p = struct.unpack_from("<Q", data, p)[0], p + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack_from("<Q", data, p)[0]
            e += 4 + m
        out.append(Member(name, offset, method, packed, plain, crc))
        k = stop + note
    return sorted(out, key=lambda m: m.offset)


def payload(f, m: Member) -> bytes:
    """A member's bytes, checked; no more is read or unpacked than the directory names."""
    if max(m.size, m.packed) > LARGEST:
        raise ValueError("the member is too long for a binary value")
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at the offset")
    n, extra = struct.unpack_from("<HH", head, 26)
    f.seek(m.offset + 30 + n + extra)
    data = f.read(m.packed)
    if m.method == 8:
        unpack = zlib.decompressobj(-15)
        data = unpack.decompress(data, m.size + 1)
    elif m.method:
        raise ValueError(f"compression method {m.method} isn't known")
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError("length or CRC-32 is wrong")
    return data


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split, self.batch, self.retries = (int(options.get(k, d)) for k, d in (("split", SPLIT), ("batch", BATCH), ("retries", RETRIES)))

    def partitions(self) -> list[ByteRange]:
        out = []
        for path in self.path.split(","):
            where, root = _open(path)
            found = where.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            if not found and (one := where.get_file_info(root)).type == pafs.FileType.File:
                found = [one]
            for x in sorted(found, key=lambda x: x.path):
                if x.type == pafs.FileType.File and x.path.endswith(".zip"):
                    for at in range(0, max(1, x.size), self.split):
                        out.append(ByteRange((path.split("://")[0] + "://" if "://" in path else "") + x.path, at, at + self.split, x.size))
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        where, path = _open(part.archive)
        members, f, why = None, None, ""
        for _ in range(self.retries + 1):
            try:
                f = where.open_input_file(path)
                members = directory(f, part.length)
                break
            except (OSError, ValueError, struct.error) as e:
                why = str(e)
        if members is None:
            if part.start == 0:
                yield self.rows(part.archive, [(None, None, None, None, why)])
            return
        held, size = [], 0
        for m in members:
            if not part.start <= m.offset < part.end:
                continue
            data, why = None, None
            for _ in range(self.retries + 1):
                try:
                    data, why = payload(f, m), None
                    break
                except (OSError, ValueError, MemoryError, struct.error, zlib.error) as e:
                    why = str(e)
                    try:
                        f = where.open_input_file(path)
                    except OSError as again:
                        why = str(again)
            held.append((m.name, m.offset, m.size, data, why))
            size += len(data or b"")
            if size >= self.batch or len(held) >= 10_000:
                yield self.rows(part.archive, held)
                held, size = [], 0
        if held:
            yield self.rows(part.archive, held)

    @staticmethod
    def rows(archive: str, held: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*held))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(held)), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["archive", "member", "offset", "size", "payload", "error"])


class ArchiveSource(DataSource):
    """Options: path (folders or files, by commas), split, batch, retries."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> MemberReader:
        return MemberReader(self.options)


def member_name(i: str | None, n: int, none: bool) -> str:
    """The name of row n's member; what ZIP tools cut names at is escaped."""
    plain = (i or "").replace("%", "%25").replace("\0", "%00").replace("\\", "%5C")
    if len(plain.encode()) > LONGEST_ID:
        raise ValueError(f"an id of more than {LONGEST_ID} bytes can't name a member: {plain[:50]}...")
    return f"{plain}/{n}{'!' if i is None else ''}{'?' if none else ''}"


def write_archives(rows: DataFrame, folder: str, id_col: str, payload_col: str, deflate: bool = True) -> int:
    """Write each row's payload as member ``id/number``; returns how many were written. ``folder`` is a shared one."""
    picked = rows.select(F.col(id_col).cast("string").alias("id"), F.col(payload_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, root = _open(folder)
        where.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}"
        temp, n = f"{name}.{task.taskAttemptId()}.{uuid.uuid4().hex}.tmp", 0
        archive = sink = None
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    sink = where.open_output_stream(temp)
                    archive = zipfile.ZipFile(_Forward(sink), "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED, compresslevel=1 if deflate else None)
                data = data.as_py()
                archive.writestr(zipfile.ZipInfo(member_name(i, n, data is None)), data or b"", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED, 1 if deflate else None)
                n += 1
        if archive is not None:
            archive.close()
            sink.close()
            if where.get_file_info(f"{name}.zip").type == pafs.FileType.NotFound:
                where.move(temp, f"{name}.zip")
            else:  # another attempt has finished with the same rows
                where.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return picked.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Forward(io.RawIOBase):
    """A stream that can only go forward; zipfile then puts sizes into the directory alone."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        return len(data)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(archive, member, offset, size, payload, error) of every member under ``folder``."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers needn't have the package
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("members").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def media_columns(members: DataFrame, id_col: str, id_type: str = "long") -> DataFrame:
    """(id, n_bytes, sha256, error) of members that ``write_archives`` wrote."""
    last = F.substring_index("member", "/", -1)
    i = F.regexp_extract("member", r"(?s)^(.*)/[^/]*$", 1)
    for code, mark in (("%5C", "\\"), ("%00", "\0"), ("%25", "%")):
        i = F.replace(i, F.lit(code), F.lit(mark))
    none = last.endswith("?")
    return members.select(F.when(~last.contains("!"), i).cast(id_type).alias(id_col), F.when(~none, F.length("payload")).cast("long").alias("n_bytes"), F.when(~none, F.sha2("payload", 256)).alias("sha256"), F.col("error"))
