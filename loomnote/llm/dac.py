"""Token ids as directly addressable codes (DAC): random access to any token without decoding a block.

An id is split into chunks of ``BITS`` bits, lowest first, and each chunk goes to the array of its level; a level's
continuation bitmap says which of its entries go on in the next level, where the entry's place is the rank of its
bit. A rank directory (ones before every 512 bits) makes the rank a lookup and one popcount of at most 64 bytes.

A blob: magic ``DAC1``, number of levels (u8), 3 bytes of zero, then for each level its number of entries (u32) and,
one after another for each level, chunks (u8 each), bitmap (bytes) and directory (u32 each). The last level of a
blob has neither bitmap nor directory.

Rows: a null text (or null list) has a null blob, an empty one a blob of no levels. A very long text is one blob, of up to
2**32 tokens. Ids may be null, and rows may repeat. An empty table gives no rows. Only the id and the text (or list)
column are read, so columns with the names of results are safe.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote.llm import bpe, spans

BITS = 8
BLOCK = 64  # bytes of bitmap for an entry of the directory
MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    v = np.asarray(ids)
    if len(v) and int(v.min()) < 0:
        raise ValueError("token ids can't be negative")
    v = v.astype(np.uint32)
    head, body = [], []
    while len(v):
        head.append(len(v))
        body.append((v & np.uint32(0xFF)).astype(np.uint8).tobytes())
        rest = v >> np.uint32(BITS)
        more = rest != 0
        v = rest[more]
        if len(v):
            bits = np.packbits(more, bitorder="little")
            ones = np.bitwise_count(bits)
            sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.uint32)
            directory = np.zeros(len(sums), dtype="<u4")
            np.cumsum(sums[:-1], out=directory[1:])
            body += [bits.tobytes(), directory.tobytes()]
    return b"".join([MAGIC, bytes([len(head), 0, 0, 0]), struct.pack(f"<{len(head)}I", *head), *body])


class Reader:
    """Random access to a blob's ids: ``reader[i]``, ``len(reader)``, ``reader.all()``."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC1 blob")
        levels = blob[4]
        self.n = struct.unpack_from(f"<{levels}I", blob, 8)
        self.blob, at, self.at = blob, 8 + 4 * levels, []
        for k, n in enumerate(self.n):
            bits, size = at + n, (n + 7) // 8
            self.at.append((at, bits, bits + size))
            at += n + (size + 4 * -(-size // BLOCK) if k + 1 < levels else 0)

    def __len__(self) -> int:
        return self.n[0] if self.n else 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.at):
            value |= self.blob[chunks + i] << (BITS * k)
            if k + 1 == len(self.at) or not self.blob[bits + i // 8] >> (i % 8) & 1:
                break
            block = i // 8 // BLOCK
            part = int.from_bytes(self.blob[bits + block * BLOCK : bits + i // 8 + 1], "little")
            part &= (1 << (i - block * BLOCK * 8)) - 1
            i = struct.unpack_from("<I", self.blob, directory + 4 * block)[0] + part.bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), dtype=np.uint32)
        at = np.arange(len(self))
        for k, (chunks, bits, _) in enumerate(self.at):
            out[at] |= np.frombuffer(self.blob, np.uint8, self.n[k], chunks).astype(np.uint32) << np.uint32(BITS * k)
            if k + 1 < len(self.at):
                at = at[np.unpackbits(np.frombuffer(self.blob, np.uint8, (self.n[k] + 7) // 8, bits), count=self.n[k], bitorder="little").astype(bool)]
        return out


_cache: dict[int, bpe.PieceCache] = {}


def _piece_cache(ranks: bytes) -> bpe.PieceCache:
    """Pieces are encoded by the library here; the tests hold it against ``bpe``."""
    if hash(ranks) not in _cache:
        import base64

        table = {base64.b64decode(t): int(n) for t, n in map(bytes.split, ranks.splitlines()) if t}
        one = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={})
        _cache.clear()
        _cache[hash(ranks)] = bpe.PieceCache(one._encode_single_piece)
    return _cache[hash(ranks)]


def write_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, dac): each text's tokens as a blob."""
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("dac", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _piece_cache(ranks.value)
        for batch in batches:
            valid = np.asarray(batch.column(1).is_valid())
            for i, j, tokens, at in bpe.tokenize(batch.column(1), cache):
                ends = at.tolist()
                blobs = [encode(tokens[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], valid[i:j].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(at), mask=~valid[i:j]), pa.array(blobs, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def pick(blobs: DataFrame, place: str, dac_col: str = "dac") -> DataFrame:
    """Adds ``token``: the id at 0-based ``place`` (an integer column); null beyond the ends or for a null blob."""

    @F.pandas_udf(T.LongType())
    def at(blob, i):
        import pandas as pd

        def one(b, k):
            if b is None or pd.isna(k):
                return None
            r = Reader(b)
            return r[int(k)] if 0 <= k < len(r) else None

        return pd.Series([one(b, k) for b, k in zip(blob, i)], dtype="Int64")

    return blobs.withColumn("token", at(F.col(dac_col), F.col(place)))
