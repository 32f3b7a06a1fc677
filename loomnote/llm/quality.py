"""Quality rules: a calibrated logistic regression over hashed word and character n-grams.

Features of a text are the means of three families over hashed buckets: single words, pairs of adjacent words and
character n-grams (2 to 4 bytes). A word is a run without white space, case and marks kept, because style is what
tells junk; white space is that of Unicode, and ASCII controls count as such. A pair of two equal words is one bucket
of its own, whatever the word. A score is the intercept plus, for each family, the mean weight of its grams, so scoring
needs no sparse vectors: one gather and one sum per family.

Training uses at most ``sample`` different labelled texts (``SAMPLE``), in the order of a hash of the text; copies
count once. So that the driver can hold them, the sample also ends with the text that brings its characters to
``sample_chars`` (``SAMPLE_CHARS``). No text is left out for its own length, and every text is scored. 3 in 4 train
(AdaGrad on the log loss, classes weighted alike), 1 in 4 calibrate (Platt scaling by Newton steps, with the label
shares as they are; where either part would lack a class, all rows do both). Scoring covers every text in Arrow
batches and compares with the fixed threshold ``KEEP``.

Rows: a null or empty text, or one without any word, has probability 0 and is rejected. Labels that are null, or of
ids that have no text, are left out; a text whose rows have several labels counts with the more frequent one, the lower
on a tie. Ids and texts may repeat. Very long texts train and are scored like others. With fewer than two classes in
the sample the probability is the share of good texts, (good + 1) / (all + 2), for every text that has a word. An empty
table gives no rows. Only the id, text and label columns are read, so names that clash with those of results are safe;
``filter_quality`` returns the rows with all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote.llm import spans

SAMPLE = 4000
SAMPLE_CHARS = 100_000_000
KEEP = 0.5
BITS = 18
FAMILIES = 3
_SAME = np.uint64(0x51_7C_C1_B7)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the bucket of each gram and the offsets of the texts' grams."""
    shift, n = np.uint64(64 - BITS), len(data)
    starts, ends = spans.runs(~spans.white_mask(data), offsets)
    at = np.searchsorted(starts, offsets)
    h = spans.span_hashes(data, starts, ends)
    out = [((h >> shift).astype(np.int32), at)]
    if len(h) > 1:
        row = spans.rows_of(starts, offsets)
        pair = spans.mix(h[:-1] * np.uint64(3) + h[1:])
        pair[h[:-1] == h[1:]] = _SAME << np.uint64(32)
        inside = row[1:] == row[:-1]
        second = np.flatnonzero(inside) + 1
        out.append(((pair[inside] >> shift).astype(np.int32), np.searchsorted(second, at)))
    else:
        out.append((np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)))
    wide, buckets = data.astype(np.uint32), []
    for k in (2, 3, 4):
        if n < k:
            continue
        g = wide[: n - k + 1]
        for j in range(1, k):
            g = g << np.uint32(8) | wide[j : n - k + 1 + j]
        g = (g * np.uint32(0x9E3779B1) + np.uint32(k)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        buckets.append(g.astype(np.int32))
    out.append((buckets, offsets))
    return out


def _sums(weights: np.ndarray, families: list, n: int) -> np.ndarray:
    """(FAMILIES, n) mean weights."""
    out = np.zeros((FAMILIES, n))
    for f, (bucket, at) in enumerate(families[:2]):
        c = np.concatenate([[0.0], np.cumsum(weights[f][bucket], dtype=np.float64)])[at]
        out[f] = np.diff(c) / np.maximum(np.diff(at), 1)
    buckets, offsets = families[2]
    total, count = np.zeros(n), np.zeros(n)
    for g, k in zip(buckets, (2, 3, 4)):
        c = np.concatenate([[0.0], np.cumsum(weights[2][g], dtype=np.float64)])
        lo, hi = offsets[:-1], np.maximum(offsets[1:] - k + 1, offsets[:-1])
        total += c[np.minimum(hi, len(g))] - c[np.minimum(lo, len(g))]
        count += hi - lo
    out[2] = total / np.maximum(count, 1)
    return out


class Model:
    """weights (FAMILIES, 2**BITS) float32, intercept, and the calibration p = 1 / (1 + exp(-(a * score + b)))."""

    def __init__(self, weights: np.ndarray | None, intercept: float, a: float, b: float, prior: float = 0.5):
        self.weights, self.intercept, self.a, self.b, self.prior = weights, intercept, a, b, prior

    def raw(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether there is a word) of each text."""
        score, some = np.zeros(len(column)), np.zeros(len(column), dtype=bool)
        for i, j, data, offsets in spans.chunks(column, spans.CHUNK >> 1):
            families = grams(data, offsets)
            some[i:j] = np.diff(families[0][1]) > 0
            if self.weights is not None:
                score[i:j] = self.intercept + _sums(self.weights, families, j - i).sum(axis=0)
        return score, some

    def probability(self, column: pa.Array) -> np.ndarray:
        score, some = self.raw(column)
        p = np.full(len(score), self.prior) if self.weights is None else _sigmoid(self.a * score + self.b)
        return np.where(some, p, 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the calibration, with Platt's softened targets."""
    good, bad = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([score, np.ones_like(score)], axis=1)
    for _ in range(50):
        p = _sigmoid(x @ ab)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t))
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def fit(texts: list[str | None], good: list[int], epochs: int = 6, rate: float = 0.5) -> Model:
    """Train on (text, 0 or 1); the order of the rows decides which of them calibrate (every fourth)."""
    y = np.asarray(good, dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model(None, 0.0, 1.0, 0.0, (y.sum() + 1) / (len(y) + 2))
    hold = np.arange(len(y)) % 4 == 3
    if len(set(y[hold].tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        hold = np.zeros(len(y), dtype=bool)
    train = np.flatnonzero(~hold)
    column = pa.array(texts, pa.large_string())
    share = y[train].mean()
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w, g2 = np.zeros((FAMILIES, 1 << BITS), dtype=np.float32), np.full((FAMILIES, 1 << BITS), 1e-8)
    model, b2, size, rng = Model(w, 0.0, 1.0, 0.0), 1e-8, 1 << BITS, np.random.default_rng(7)
    order = train.copy()
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            data, offsets, _ = spans.buffers(column.take(pa.array(rows)))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            families = grams(data, offsets)
            p = _sigmoid(model.intercept + _sums(w, families, len(rows)).sum(axis=0))
            d = (p - y[rows]) * cost[rows] / len(rows)
            for f, (bucket, at) in enumerate(families[:2]):
                count = np.diff(at)
                grad = np.bincount(bucket, np.repeat(d / np.maximum(count, 1), count), size)
                g2[f] += grad * grad
                w[f] -= rate * grad / np.sqrt(g2[f])
            grad, total = np.zeros(size), np.zeros(len(rows))
            parts = [(np.minimum(offsets[:-1], len(g)), np.minimum(np.maximum(offsets[1:] - n + 1, offsets[:-1]), len(g))) for g, n in zip(families[2][0], (2, 3, 4))]
            for lo, hi in parts:
                total += hi - lo
            each = d / np.maximum(total, 1)
            for g, (lo, hi) in zip(families[2][0], parts):
                v = np.zeros(len(g) + 1)
                np.add.at(v, lo, each)
                np.add.at(v, hi, -each)
                grad += np.bincount(g, np.cumsum(v[:-1]), size)
            g2[2] += grad * grad
            w[2] -= rate * grad / np.sqrt(g2[2])
            b2 += d.sum() ** 2
            model.intercept -= rate * d.sum() / np.sqrt(b2)
    check = np.flatnonzero(hold) if hold.any() else train
    score, _ = model.raw(column.take(pa.array(check)))
    model.a, model.b = _platt(score, y[check])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[int]]:
    """The sample: different texts and their labels. Only ids, hashes and lengths are joined; texts come for those chosen."""
    given = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).where("id is not null and y is not null")
    given = given.groupBy("id").agg(F.sum("y").alias("good"), F.count("y").alias("all"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    marked = rows.select("id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).join(given, "id")
    texts = marked.groupBy("h").agg(F.min("id").alias("id"), F.sum("good").alias("good"), F.sum("all").alias("all"), F.max("n").alias("n"))
    chosen, chars = [], 0
    for r in texts.orderBy("h").limit(sample).collect():
        chosen.append((r.id, r.h, int(2 * r.good > r["all"])))
        chars += r.n
        if chars >= sample_chars:
            break
    if not chosen:
        return [], []
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("h", T.LongType()), T.StructField("y", T.IntegerType())])
    some = F.broadcast(docs.sparkSession.createDataFrame(chosen, schema))  # at most `sample` rows
    found = rows.join(some.select("id", F.col("h").alias("want"), "y"), "id").where(F.xxhash64("text") == F.col("want"))
    found = found.groupBy("want").agg(F.any_value("text").alias("text"), F.any_value("y").alias("y")).collect()
    found.sort(key=lambda r: r.want)
    return [r.text for r in found], [r.y for r in found]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``sample`` different labelled texts of ``docs``."""
    return fit(*training_rows(docs, labels, sample, sample_chars, id_col, text_col, label_col))


def score(docs: DataFrame, model: Model, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, probability, kept) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= keep)], names=schema.names)

    return rows.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, model: Model, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose probability reaches ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.probability(pc.cast(batch.column(place), pa.string())) >= keep))

    return docs.mapInArrow(run, docs.schema)
