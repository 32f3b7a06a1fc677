"""Near-duplicates by SimHash, searched through a byte-position inverted index with count filtering.

Fingerprint. The distinct folded words of a text vote on ``8 * BYTES`` bits (256): a bit is set where more than half
of the words' hashes have it. Two texts with cosine c of their word sets differ in about ``acos(c) / pi`` of the bits.

Index. Texts with one fingerprint are one node, so exact copies cost nothing more. A node is posted once for each byte
position but the last two, under that position and its byte there; inside such a list nodes meet if they share two more
bytes, at any two later positions. So any two nodes that share three bytes meet, in the list of the first of them. Where
such lists would be longer than ``LIST`` (beyond 10**9 texts), nodes are posted under every two positions instead and meet
on one more: the same pairs, in lists that are a 256th as long. Lists stream through numpy, sorted by key, and each pair
of positions is one sort of packed integers:

* filter: at least ``max(3, BYTES - max_distance)`` shared bytes, tallied for pairs that nothing connects so far: what
  any pair within the distance is sure to have or, where the distance reaches BYTES - 2 and less is sure, what a meeting
  demands anyway (then the tally is left out, as it could reject nothing);
* verify: a Hamming distance of ``max_distance`` at most.

A list gives a forest that connects what its verified pairs connect, not the pairs, so a list of m nodes gives fewer
than m edges; none is capped. Groups are the connected components of all edges. A pair can only be missed if it shares
fewer than three bytes: none up to 29 bits, under 1 % of those at 45 to 48 bits (measured on random texts); the texts
of a group are found through each other as well (recall against brute force is tested, by band of distance).

Postings are ``BYTES - 2`` rows of 40 bytes for each distinct fingerprint (465 where lists are of two positions), and the
pairs that meet by chance are a 1 / 2**24 of all for each of the 4960 position triples, so that verifying grows with the
square of the corpus beyond some 10**8 texts.

Rows: a null text, or one without words, has no fingerprint and is never a duplicate. Repeated rows (one id, one
text) are duplicates of each other; ids may be null. The first by (id, hash of the text) stays for its group, null ids
first. Very long texts are fingerprinted whole. An empty table gives no rows. Columns whose names clash with those used
here are safe; ``drop_duplicates`` keeps all columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote import session
from loomnote.llm import spans

BYTES = 32
MAX_DISTANCE = 48
SHARED = 3
PAIRS = 1 << 18
LIST = 1 << 22
_SALTS = np.random.default_rng(5).integers(1, 1 << 63, BYTES // 8, dtype=np.uint64)


def tables(depth: int = 1) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """The byte positions that nodes are posted under, ``depth`` at a time, each with the later ones where they may meet."""
    return [(named, np.arange(named[-1] + 1, BYTES)) for named in itertools.combinations(range(BYTES), depth) if named[-1] < BYTES - SHARED + depth]


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, BYTES) fingerprints and whether the text has any word."""
    out, some = np.zeros((len(column), BYTES), dtype=np.uint8), np.zeros(len(column), dtype=bool)
    for i, _, data, offsets in spans.chunks(column, spans.CHUNK >> 1):
        data = spans.fold_case(data)
        starts, ends = spans.runs(spans.word_mask(data), offsets)
        if not len(starts):
            continue
        h, row = spans.span_hashes(data, starts, ends), spans.rows_of(starts, offsets)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        words = np.diff(np.append(first, len(row)))
        bits = np.unpackbits(np.stack([spans.mix(h + s) for s in _SALTS], axis=1).view(np.uint8), axis=1)
        votes = _votes(bits, first, words)
        out[i + row[first]] = np.packbits(2 * votes > words[:, None], axis=1)
        some[i + row[first]] = True
    return out, some


def _votes(bits: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``bits`` (0 or 1) from each ``first`` on: eight columns at a time as the bytes of one number, 255 rows at most."""
    lots = -(-count // 255)
    at = np.concatenate([[0], np.cumsum(lots)[:-1]])
    begin = np.repeat(first, lots) + 255 * (np.arange(int(lots.sum())) - np.repeat(at, lots))
    sums = np.add.reduceat(bits.view(np.uint64), begin, axis=0).view(np.uint8)
    return np.add.reduceat(sums, at, axis=0, dtype=np.int32)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) of each row: th a hash of its text, fp null where there is no word."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, some = fingerprints(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(fp, ~some)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _binary(fp: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    flat = np.ascontiguousarray(fp)
    a = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.arange(0, BYTES * len(fp) + 1, BYTES, dtype=np.int32)), pa.py_buffer(flat)])
    return a if null is None or not null.any() else pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), a)


def _matrix(column: pa.Array) -> np.ndarray:
    _, off, data = column.buffers()
    start = int(np.frombuffer(off, np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(data, np.uint8, BYTES * len(column), start).reshape(-1, BYTES) if len(column) else np.zeros((0, BYTES), np.uint8)


def link(key: np.ndarray, fp: np.ndarray, where: list[np.ndarray] | np.ndarray, max_distance: int = MAX_DISTANCE, more: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key (table << 16 | what a list shares): the edges (a, b) of a forest over the verified pairs of its lists.

    Rows of a list meet if they share ``more`` (1 or 2) of the bytes at ``where[table]``.
    """
    n, label = len(key), np.arange(len(key))
    if n > 1:  # rows that are alone in their list meet nobody
        rows = _runs(key)
        table = key[rows] >> 16
        for t in np.unique(table).tolist():
            _probe(rows[table == t], key, fp, where[t], label, max_distance, more)
    b = np.flatnonzero(label != np.arange(n))
    return label[b], b


def _runs(values: np.ndarray) -> np.ndarray:
    """The places in sorted ``values`` whose value another place has too."""
    same = np.concatenate([[False], values[1:] == values[:-1], [False]])
    return np.flatnonzero(same[1:] | same[:-1])


def _probe(rows: np.ndarray, key: np.ndarray, fp: np.ndarray, where: np.ndarray, label: np.ndarray, max_distance: int, more: int) -> None:
    """Join in ``label`` what verified pairs connect, among ``rows`` of one table, for each ``more`` positions of ``where``."""
    part, low = np.ascontiguousarray(fp[rows][:, where].T), len(rows).bit_length()
    wide = np.ascontiguousarray(fp).view(np.uint64)
    at = np.append(0, np.cumsum(key[rows][1:] != key[rows][:-1])) << 8 * more + low | np.arange(len(rows))  # list, bytes, row
    for j in range(len(where) - 1) if more == 2 else (-1,):
        first = at
        if more == 2:
            first = np.sort(at | part[j].astype(np.int64) << 8 + low)
            first = first[_runs(first >> low)]
        rest = part[j + 1 :, first & (1 << low) - 1]
        for second in rest if len(first) else ():
            both = second.astype(np.int64)
            both <<= low
            both |= first
            both.sort()
            if (both[1:] ^ both[:-1]).min() >> low == 0:
                both = both[_runs(both >> low)]
                _meet(both >> low, rows[both & (1 << low) - 1], wide, label, max_distance)


def _meet(sub: np.ndarray, rows: np.ndarray, wide: np.ndarray, label: np.ndarray, max_distance: int) -> None:
    """Verify the pairs of each run of ``sub`` whose components differ, and join those in ``label``."""
    order = np.lexsort((label[rows], sub))
    sub, rows = sub[order], rows[order]
    cut = sub[1:] != sub[:-1]
    stop = _ends(cut)
    after = _ends(cut | (label[rows][1:] != label[rows][:-1]))  # a row is compared with those after its own component
    count = stop - after
    alive = np.flatnonzero(count)
    total = np.append(0, np.cumsum(count[alive]))
    k = 0
    while k < len(alive):
        to = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS, side="right")) - 1)
        some = count[alive[k:to]]
        a = np.repeat(alive[k:to], some)
        b = after[a] + np.arange(len(a)) - np.repeat(total[k:to] - total[k], some)
        a, b, k = rows[a], rows[b], to
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        x = wide[a] ^ wide[b]
        if BYTES - max_distance > SHARED:  # else all that meet have enough
            enough = (x.view(np.uint8) == 0).sum(axis=1) >= BYTES - max_distance
            a, b, x = a[enough], b[enough], x[enough]
        ok = np.bitwise_count(x).sum(axis=1, dtype=np.int32) <= max_distance
        if ok.any():
            _hook(label, a[ok], b[ok])


def _ends(cut: np.ndarray) -> np.ndarray:
    """For each place the end of its run; ``cut`` says where a place differs from the one before."""
    end = np.append(np.flatnonzero(cut) + 1, len(cut) + 1)
    return np.repeat(end, np.diff(np.append(0, end)))


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]: every label becomes the least row of its component."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        more = low != high
        if not more.any():
            return
        a, b, low, high = a[more], b[more], low[more], high[more]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _postings(nodes: DataFrame, named: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): each node under the bytes that it has at the positions of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _matrix(batch.column(0))
            for k in range(0, len(fp), 8192 * 30 // len(named)):
                part = fp[k : k + 8192 * 30 // len(named)]
                key = np.zeros((len(part), len(named)), dtype=np.int64)
                for column in np.array(named).T:
                    key = key << 8 | part[:, column]
                key |= np.arange(len(named), dtype=np.int64) << 16
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), _binary(np.repeat(part, len(named), axis=0))], names=["key", "fp"])

    return nodes.mapInArrow(run, "key long, fp binary")


def edges(nodes: DataFrame, max_distance: int = MAX_DISTANCE, depth: int = 1) -> DataFrame:
    """(a, b) with a < b: links that connect the fingerprints of ``nodes`` (fp binary, distinct) as verified pairs do."""
    named, where = zip(*tables(depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, fp = np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held])
            a, b = link(key, fp, where, max_distance, SHARED - depth)
            return pa.RecordBatch.from_arrays([_binary(fp[a]), _binary(fp[b])], names=["a", "b"])

        for batch in batches:  # rows come sorted by key; the last key's rows wait for the next batch
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if held and cut == 0 and key[0] == held[0][0][-1]:
                held.append((key.copy(), fp.copy()))
                continue
            held.append((key[:cut], fp[:cut]))
            yield out()
            held = [(key[cut:].copy(), fp[cut:].copy())]
        if held:
            yield out()

    posted = _postings(nodes.select("fp"), named).repartition("key").sortWithinPartitions("key")
    found = posted.mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of ``pairs`` (a, b): root is the least node of its connected component.

    Alternating large-star and small-star steps; each round's links are written to the shared folder.
    """
    links = session.cut(pairs.where(F.col("a") < F.col("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = session.cut(small.where("a > b").distinct().select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def _grouped(docs: DataFrame, id_col: str, text_col: str, **search: int) -> DataFrame:
    """(id, th, gid) of all rows that are in a group of two rows at least."""
    fps = session.cut(with_fingerprints(docs, id_col, text_col).where("fp is not null"))
    nodes = fps.groupBy("fp").agg(F.count("*").alias("rows"))
    search.setdefault("depth", 1 if fps.count() <= 256 * LIST else 2)
    roots = components(edges(nodes, **search))
    near = roots.select(F.col("node").alias("fp"), F.col("root").alias("gid"))
    near = near.unionByName(roots.select(F.col("root").alias("fp"), F.col("root").alias("gid")).distinct())
    exact = nodes.where("rows > 1").select("fp").join(near.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("gid"))
    return fps.join(near.unionByName(exact), "fp").select("id", "th", "gid")


def _first(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("gid").agg(F.min(F.struct("id", "th")).alias("first"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search: int) -> DataFrame:
    """(id, duplicate_of): each row that isn't the first of its group, with the first one's id."""
    grouped = session.cut(_grouped(docs, id_col, text_col, **search))
    order = Window.partitionBy("gid", "id", "th").orderBy(F.lit(1))
    rest = grouped.withColumn("nth", F.row_number().over(order)).join(_first(grouped), "gid")
    rest = rest.where(~(F.struct("id", "th").eqNullSafe(F.col("first")) & (F.col("nth") == 1)))
    return rest.select(F.col("id").alias(id_col), F.col("first.id").alias("duplicate_of"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search: int) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the first of each group.

    The list of rows to go grows with the corpus, so it is never broadcast: one merge join by two hashes of id and text
    brings it to the rows, which are shuffled once, and a window over the same keys lets one of repeated rows stay.
    """
    grouped = session.cut(_grouped(docs, id_col, text_col, **search))
    keys = grouped.groupBy("gid", "id", "th").agg(F.count("*").alias("rows")).join(_first(grouped), "gid")
    wide = "_" * max(map(len, docs.columns))
    key, th, stays, nth = (name + wide for name in ("key", "th", "stays", "nth"))
    marked = keys.select(F.xxhash64("id", "th").alias(key), F.col("th").alias(th), F.struct("id", "th").eqNullSafe(F.col("first")).alias(stays))
    rows = docs.withColumn(th, F.xxhash64(docs[text_col])).withColumn(key, F.xxhash64(docs[id_col], F.col(th)))
    rows = rows.join(marked.hint("merge"), [key, th], "left")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, th).orderBy(key)))
    return rows.where(F.col(stays).isNull() | (F.col(stays) & (F.col(nth) == 1))).select(*docs.columns)
