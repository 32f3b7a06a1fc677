"""Packing into optimal length buckets, with token-budget batches inside each bucket.

A document's length is its number of tokens in the vocabulary given, counted by ``tokencount``; lengths are written
once to the shared folder, so texts are read and counted once. The driver gets the histogram of lengths (at most one
row for each distinct length, however many documents there are) and finds, by dynamic programming, the ``buckets``
upper lengths for which the padding over the whole corpus is least: cost(i, j) = length_j * documents(i..j) -
tokens(i..j), solved exactly in integers with a monotone hull of lines, O(buckets * lengths).

Every document goes to the first bucket that holds it and a batch of a bucket has ``max(1, budget // upper length)``
documents, so a batch padded to that length stays within the budget unless a single document exceeds it. To form
batches without one sort of a whole bucket, a bucket is cut into shards by a hash, in proportion to its documents
(about ``SHARD`` each); only a shard's last batch can be short, so that a bucket has at most one short batch for each
``SHARD`` documents or part of it. Equal rows are counted first and dealt to the shards in lots of at most ``SHARD``,
so no row that is repeated without end meets in one task. The result doesn't depend on the partitioning.

Rows: a null text counts as empty; empty documents have length 0 and go to a bucket of length 0 or more like any
other. A very long text is counted whole; beyond the budget it is a batch of its own. Repeated rows are packed each;
ties go by hash, then id; ids may be null. Extra columns are ignored, whatever their names. No documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomnote import session
from loomnote.llm import tokencount

BUCKETS = 16
BUDGET = 16384
SHARD = 50_000


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with least padding; the histogram has (length, documents)."""
    rows = sorted((int(n), int(c)) for n, c in histogram if c > 0)
    if not rows:
        return []
    lengths = [n for n, _ in rows]
    docs, tokens = [0], [0]
    for n, c in rows:
        docs.append(docs[-1] + c)
        tokens.append(tokens[-1] + n * c)
    m = len(rows)
    best = [0 if not j else lengths[j - 1] * docs[j] - tokens[j] for j in range(m + 1)]
    back = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        now, come = best[:], [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # lines x -> c - d * x, x = a length, in order of d; the first is best
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if i:
                line = (docs[i], best[i] + tokens[i], i)
                while len(hull) - head >= 2:
                    (d1, c1, _), (d2, c2, _) = hull[-2], hull[-1]
                    if (line[1] - c1) * (d2 - d1) <= (c2 - c1) * (line[0] - d1):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][1] - hull[head + 1][0] * x <= hull[head][1] - hull[head][0] * x:
                head += 1
            if head < len(hull):
                d, c, k = hull[head]
                cost = x * docs[j] - tokens[j] + c - d * x
                if cost < now[j]:
                    now[j], come[j] = cost, k
        best = now
        back.append(come)
    out, j = [], m
    for come in reversed(back):
        out.append(lengths[j - 1])
        j = come[j]
        if not j:
            break
    return out[::-1]


def lengths(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n) of every row: h a hash of id and text, n the tokens."""
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).alias("key"), F.col(text_col).alias("text"))
    return tokencount.count_tokens(rows, ranks_path, "key", "text").select("key.id", "key.h", F.coalesce("n_tokens", F.lit(0)).alias("n"))


def pack(docs: DataFrame, ranks_path: str, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(id, n_tokens, bucket, padded_to, batch, padding) of every row; batches are named ``bucket-shard-number``."""
    rows = session.cut(lengths(docs, ranks_path, id_col, text_col))
    histogram = rows.groupBy("n").agg(F.count("*").alias("docs")).collect()
    upper = boundaries([(r.n, r.docs) for r in histogram], buckets) or [0]
    count, k = [0] * len(upper), 0
    for r in sorted(histogram, key=lambda r: r.n):
        while r.n > upper[k]:
            k += 1
        count[k] += r.docs
    bucket = F.lit(len(upper) - 1)
    for k in range(len(upper) - 2, -1, -1):
        bucket = F.when(F.col("n") <= upper[k], k).otherwise(bucket)
    size = [max(1, budget // max(1, u)) for u in upper]
    shards = [max(1, -(-c // max(shard // s * s, s))) for c, s in zip(count, size)]

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)

    equal = rows.groupBy("h", "id", "n").agg(F.count("*").alias("rows")).withColumn("bucket", bucket.cast("int"))
    lots = equal.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / shard))))
    lots = lots.withColumn("rows", F.least(F.col("rows") - F.col("lot") * shard, F.lit(shard)))
    lots = lots.withColumn("shard", F.pmod(F.when(F.col("lot") == 0, F.col("h")).otherwise(F.xxhash64("h", "lot")), of(shards)))
    order = Window.partitionBy("bucket", "shard").orderBy("h", "id", "n", "lot")
    first = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lots.withColumn("first", first).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    batch = F.concat_ws("-", "bucket", "shard", F.floor((F.col("first") + F.col("nth")) / of(size)).cast("long"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", of(upper).alias("padded_to"), batch.alias("batch"), (of(upper) - F.col("n")).alias("padding"))
