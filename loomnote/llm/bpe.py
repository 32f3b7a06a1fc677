"""Exact byte-level BPE by backtracking, and decoding through an offset table.

``Vocab`` prepares, from a rank file (``base64 rank`` lines, ranks in merge order):

* an Aho-Corasick automaton of all tokens, whose one pass over a piece gives the longest token at every place;
* ``shorter``: of each token the longest token that is a proper prefix of it;
* the pair-compatibility table: whether two adjacent tokens can both survive the merges. A pair's entry is derived
  from the tokens' last merges and kept, so that it is computed once;
* ``blob`` and ``begin``: all tokens' bytes in a row and where each begins, for decoding.

``encode_piece`` walks a piece with longest matches, falls back to shorter ones where a pair isn't compatible, and
marks dead ends so that each place fails only once: linear in the piece. The tokens are those of the merges, which
the tests prove against a merge-by-merge encoder and against an independent library.

Texts are cut into pre-tokens first (``spans.pretokens``); pieces are encoded once per Python worker and kept in a
``PieceCache``, whose size is bounded (it is emptied when full, which costs time, never results).

Rows: a null text gives null tokens; an empty text an empty list. Repeated rows and ids give repeated results; ids
may be null. Very long texts are encoded whole, empty tables give no rows. Only the id and the text column are read, so
further columns, whatever their names, have no effect. Decoding: a null list gives a null text, an empty one "". A list
with a null, a negative number or one that the vocabulary lacks gives a null text, and their number in ``n_bad``. Bytes
that aren't UTF-8, as a list may have that is part of a text's, become U+FFFD.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote.llm import spans


def read_ranks(path: str) -> bytes:
    """The rank file at ``path``; read on the driver, sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


class Vocab:
    def __init__(self, ranks: bytes):
        by_id = {int(n): base64.b64decode(t) for t, n in map(bytes.split, ranks.splitlines()) if t}
        self.tokens = [by_id[i] for i in range(len(by_id))]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.lens = [len(t) for t in self.tokens]
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        ids = self.ids
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in self.tokens]
        self._compatible: dict[int, bool] = {}
        self._merged: dict[int, int] = {}
        self.left = list(range(len(self.tokens)))
        self.right = list(range(len(self.tokens)))
        for i, t in enumerate(self.tokens):
            a = self.shorter[i]
            while a >= 0:
                b = ids.get(t[self.lens[a] :], i)
                if a < i and b < i and self._derive(a, b):
                    self._merged[a << 32 | b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]

    def _derive(self, a: int, b: int) -> bool:
        """Undo the later of the two merges at the border, again and again: does an earlier merge reach across it?"""
        bound = 1 << 31
        merged, left, right = self._merged, self.left, self.right
        while True:
            if merged.get(a << 32 | b, bound) < bound:
                return False
            for later in (a > b, a <= b):  # the side with the later merge opens; if it is a single byte, the other one
                if later:
                    bound, a, whole = a, right[a], a
                    single = a == whole
                else:
                    bound, b, whole = b + 1, left[b], b
                    single = b == whole
                if not single:
                    break
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 250_000:
                self._compatible.clear()
            known = self._compatible[key] = self._derive(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None and self.alone(whole):
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (i, k) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - k + 1] = i
        lens, shorter, known = self.lens, self.shorter, self._compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + lens[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = known.get(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= lens[token]
        return out

    def alone(self, i: int) -> bool:
        """Whether token i's bytes encode as token i by themselves: it is a byte, or its last merge is on record."""
        return self.lens[i] == 1 or self.left[i] != i

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``, gathered by the offset table without a loop."""
        begin = self.begin[ids]
        lens = self.begin[np.asarray(ids) + 1] - begin
        total = int(lens.sum())
        out = np.zeros(len(lens), dtype=np.int64)
        np.cumsum(lens[:-1], out=out[1:])
        return self.blob[np.arange(total) + np.repeat(begin - out, lens)].tobytes()


class HashTable:
    """64-bit keys to small numbers, by open addressing in numpy arrays that are looked up and filled a batch at a time.

    At most three quarters full, so a key takes 16 to 32 bytes. Keys are hashes already; 0 marks a free place.
    """

    def __init__(self):
        self.keys, self.values, self.n = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        mask, out, todo = len(self.keys) - 1, np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != 0)]
            at[todo] = (at[todo] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put keys that aren't there, all different."""
        if 4 * (self.n + len(keys)) > 3 * len(self.keys):
            old = self.keys != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = 1 << (4 * len(keys) // 3).bit_length()
            self.keys, self.values, self.n = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32), 0
        mask, todo = len(self.keys) - 1, np.arange(len(keys))
        self.n += len(keys)
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[at[todo]] == 0
            first = todo[free]
            self.keys[at[first]] = keys[first]  # of several keys for one place, one gets it
            won = self.keys[at[first]] == keys[first]
            self.values[at[first[won]]] = values[first[won]]
            todo = np.concatenate([todo[~free], first[~won]])
            at[todo] = (at[todo] + 1) & mask


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different hashes, where each is first, which each one is); none is 0."""
    return np.unique(np.maximum(hashes, np.uint64(1)), return_index=True, return_inverse=True)


class CountCache:
    """The number of tokens of pieces, by a piece's hash. At ``most`` pieces it is emptied, which costs time, never results."""

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = 1_500_000):
        self.encode, self.most, self.table = encode, most, HashTable()

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        unique, first, inverse = _different(hashes)
        if self.table.n + len(unique) > self.most:
            self.table = HashTable()
        found = self.table.find(unique)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = data.tobytes()
            found[new] = [len(self.encode(raw[a:b])) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self.table.add(unique[new], found[new].astype(np.int32))
        return found[inverse]


class PieceCache:
    """Token ids of pieces, by a piece's hash; filled as pieces turn up, and emptied like ``CountCache``."""

    def __init__(self, encode: Callable[[bytes], list[int]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.table, self.used = HashTable(), 0
        self.count, self.at = np.zeros(1024, dtype=np.int32), np.zeros(1024, dtype=np.int32)
        self.ids = np.zeros(4096, dtype=np.int32)

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each piece; pieces that are new get encoded."""
        unique, first, inverse = _different(hashes)
        if self.table.n + len(unique) > self.most or self.used + len(data) >= 1 << 31:
            self.clear()
        found = self.table.find(unique)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw, base = data.tobytes(), self.table.n
            encoded = [self.encode(raw[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self.table.add(unique[new], np.arange(base, base + len(new), dtype=np.int32))
            count = np.fromiter(map(len, encoded), dtype=np.int32, count=len(new))
            flat = np.fromiter(itertools.chain.from_iterable(encoded), dtype=np.int32, count=int(count.sum()))
            need, full = base + len(new), self.used + len(flat)
            self.count, self.at, self.ids = _room(self.count, need), _room(self.at, need), _room(self.ids, full)
            self.count[base:need] = count
            self.at[base:need] = self.used + np.cumsum(count) - count
            self.ids[self.used : full] = flat
            self.used = full
            found[new] = np.arange(base, need)
        return found[inverse]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The token ids of a row of pieces."""
        count = self.count[slots].astype(np.int64)
        out = np.zeros(len(count), dtype=np.int64)
        np.cumsum(count[:-1], out=out[1:])
        return self.ids[np.arange(int(count.sum())) + np.repeat(self.at[slots].astype(np.int64) - out, count)]


def _room(array: np.ndarray, need: int) -> np.ndarray:
    """``array`` with room for ``need`` numbers."""
    return array if need <= len(array) else np.concatenate([array, np.zeros(need + need // 2 - len(array), dtype=array.dtype)])


def tokenize(column: pa.Array, cache: PieceCache) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, offsets of the rows' ids) of successive runs of rows."""
    for i, j, data, offsets in spans.chunks(column, spans.CHUNK >> 1):
        starts = spans.pretokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        slots = cache.slots(data, starts, ends, spans.span_hashes(data, starts, ends))
        total = np.concatenate([[0], np.cumsum(cache.count[slots], dtype=np.int64)])
        yield i, j, cache.gather(slots), total[np.searchsorted(starts, offsets)]


_built: dict[int, tuple[Vocab, PieceCache]] = {}


def worker_vocab(ranks: bytes) -> tuple[Vocab, PieceCache]:
    """The vocabulary and the cache of this Python worker."""
    key = hash(ranks)
    if key not in _built:
        v = Vocab(ranks)
        _built.clear()
        _built[key] = v, PieceCache(v.encode_piece)
    return _built[key]


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, tokens, n_bytes_back): every text's tokens, and the length of what they decode to.

    ``n_bytes_back`` is computed by decoding the tokens again and comparing them with the text; it is -1 where the
    bytes differ, which never happens.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_bytes_back", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = worker_vocab(ranks.value)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            valid = np.asarray(text.is_valid())
            data, offsets, _ = spans.buffers(text)
            for i, j, tokens, at in tokenize(text, cache):
                back = np.diff(offsets[i : j + 1])
                if vocab.decode(tokens) != data[offsets[i] : offsets[j]].tobytes():
                    back = np.array([k if vocab.decode(tokens[a:b]) == data[s : s + k].tobytes() else -1 for k, a, b, s in zip(back, at, at[1:], offsets[i:])])
                none = pa.array(~valid[i:j])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(np.diff(at), mask=~valid[i:j]), lists, pa.array(back, pa.int64(), mask=~valid[i:j])], names=schema.names)

    return rows.mapInArrow(run, schema)


def _strings(data: bytes, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    """Texts of UTF-8 bytes that lie one after another; where they aren't UTF-8, with replacements."""
    at = np.concatenate([[0], ends]).astype(np.int64)
    binary = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)])
    try:
        texts = binary.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())], pa.large_string())
    return pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), texts).cast(pa.string())


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """(id, text, n_bad) of lists of tokens; a batch's lists are decoded by one gather."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = tokens.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("array<long>").alias("tokens"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(text_col, T.StringType()), T.StructField("n_bad", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = worker_vocab(ranks.value)
        size = len(vocab.tokens)
        for batch in batches:
            lists, none = batch.column(1), ~np.asarray(batch.column(1).is_valid())
            count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten(), -1))  # without those of null lists
            at = np.concatenate([[0], np.cumsum(count)])
            wrong = (flat < 0) | (flat >= size)
            bad = np.diff(np.concatenate([[0], np.cumsum(wrong)])[at])
            ids = np.where(wrong, 0, flat)
            length = np.concatenate([[0], np.cumsum(vocab.begin[ids + 1] - vocab.begin[ids])])
            texts = _strings(vocab.decode(ids), length[at[1:]], none | (bad > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(bad, mask=none)], names=schema.names)

    return rows.mapInArrow(run, schema)
