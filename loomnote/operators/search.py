"""Lexical, vector and fused search."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomnote import schemas, session
from loomnote.functions import text as X
from loomnote.sources import vault

K1, B, RRF_K, POOL = 1.2, 0.75, 60, 50


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, id, len, positions): the inverted index; len is the document's tokens.

    A document is one row, so its tokens are grouped where they are found, in Arrow batches: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("len", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in _inverted(batch.column(0), batch.column(1).to_pylist()):
                term, ids, size, positions = part.columns
                yield pa.RecordBatch.from_arrays([term.dictionary_decode(), ids.dictionary_decode(), size, positions], names=schema.names)

    return rows.mapInArrow(run, schema)


def _inverted(ids: pa.Array, texts: list[str | None], most: int = 1 << 23) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The postings of some texts, by term and then in the texts' order, and how many tokens they have; a new one begins
    after ``most`` bytes of text. Terms and ids are dictionaries."""
    parts, size, at = [], 0, 0
    for k, t in enumerate(texts, 1):
        parts.append(X.folded(t or ""))
        size += len(parts[-1])
        if size > most or k == len(texts):
            yield _grouped(ids.slice(at, k - at), parts)
            parts, size, at = [], 0, k


def _grouped(ids: pa.Array, parts: list[bytes]) -> tuple[pa.RecordBatch, int]:
    """The postings of texts whose tokens are what spaces part in ``parts``. Tokens stay bytes of one array."""
    text = np.frombuffer(b"".join((b" ", *(x for p in parts for x in (p, b" ")))), np.uint8)  # spaces at both ends and between texts
    inside = text != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    size = np.diff(np.searchsorted(begin, np.cumsum([1, *(len(p) + 1 for p in parts)])))
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(text[inside]))
    coded = words.dictionary_encode()
    by_name = np.asarray(pc.array_sort_indices(coded.dictionary))
    rank = np.empty(len(by_name), np.uint64)
    rank[by_name] = np.arange(len(by_name), dtype=np.uint64)
    key = np.sort(rank[np.asarray(coded.indices)] << np.uint64(32) | np.arange(len(words), dtype=np.uint64))
    code, order = (key >> np.uint64(32)).astype(np.int32), key & np.uint64((1 << 32) - 1)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    place = (np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size))[order].astype(np.int32)
    new = np.ones(len(words), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    term = pa.DictionaryArray.from_arrays(pa.array(code[begin]), coded.dictionary.take(pa.array(by_name)))
    positions = pa.ListArray.from_arrays(pa.array(np.append(begin, len(words)).astype(np.int32)), pa.array(place))
    return pa.RecordBatch.from_arrays([term, pa.DictionaryArray.from_arrays(pa.array(row[begin]), ids), pa.array(size[row[begin]].astype(np.int32)), positions], names=["term", "id", "len", "positions"]), len(words)


GROUP = 10_000  # rows that are written together
POSTINGS_FILE = {"write_page_index": True, "data_page_size": 1 << 17, "dictionary_pagesize_limit": 8 << 20, "store_schema": False}
SECTION_FILE = {"use_dictionary": [n for n in schemas.SECTIONS.names if n != "vector"], "store_schema": False}


def coded_postings(ids: pa.DataType) -> pa.Schema:
    """Postings as they are made: terms and ids are dictionaries."""
    return pa.schema([("term", pa.dictionary(pa.int32(), pa.string())), ("id", pa.dictionary(pa.int32(), ids)), ("len", pa.int32()), ("positions", pa.list_(pa.int32()))])


def plain_postings(ids: pa.DataType) -> pa.Schema:
    """Postings as they are read."""
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in coded_postings(ids)])


def write_index(docs: DataFrame, key: str, words: str, folder: str) -> dict[str, int]:
    """Write the postings of the column ``words`` to ``folder``, in one pass without a shuffle, a file a task
    (``index_groups``). Returns the numbers of docs and tokens."""
    ids = to_arrow_schema(docs.schema).field(key).type
    vault.write_table(folder, plain_postings(ids).empty_table())  # there may be no task at all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = vault.Part(folder, coded_postings(ids), **POSTINGS_FILE), {"docs": 0, "tokens": 0}
        index_groups(batches, key, words, found, None, None, count)
        found.close()
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in count.values()], names=list(count))

    return docs.mapInArrow(run, "docs long, tokens long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "tokens"))).collect()[0].asDict()


def index_groups(batches: Iterator[pa.RecordBatch], key: str, words: str, found: vault.Part, rows: vault.Part | None, table: pa.Schema | None, count: dict[str, int]) -> None:
    """Write the postings of the column ``words`` to ``found`` and, where given, the rows themselves to ``rows``; add to ``count``.

    The postings of every ``GROUP`` documents are sorted by term and have their own statistics, so a scan for a term skips
    most of each file.
    """
    for group in groups(batches):
        part = pa.Table.from_batches(group).combine_chunks()
        if rows:
            rows.write(part.cast(table))
            count["vectors"] += part.num_rows - part["vector"].null_count
        count["docs"] += part.num_rows
        for index, tokens in _inverted(pa.concat_arrays(part[key].chunks), part[words].to_pylist()):
            found.write(pa.Table.from_batches([index]).cast(coded_postings(part.schema.field(key).type)))
            count["tokens"] += tokens


def write_sections(docs: DataFrame, folder: str, fill: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None) -> int:
    """Write ``docs``, as ``fill`` hands them on, to ``folder``, a file a task; returns how many have a vector."""
    table = to_arrow_schema(docs.schema)
    vault.write_table(folder, table.empty_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = vault.Part(folder, table, **SECTION_FILE), 0
        for group in groups(fill(batches) if fill else batches):
            part = pa.Table.from_batches(group).cast(table)
            rows.write(part)
            n += part.num_rows - part["vector"].null_count
        rows.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return docs.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    group, n = [], 0
    for b in batches:
        if b.num_rows:
            group.append(b)
            n += b.num_rows
        if n >= GROUP:
            yield group
            group, n = [], 0
    if group:
        yield group


def query_postings(docs: DataFrame, id_col: str, text: Column, terms: Collection[str]) -> tuple[DataFrame, DataFrame]:
    """``postings`` of ``terms`` alone, and ``statistics`` of all documents: for one query over texts without an index.

    Every text is tokenized; what is written once is the terms' postings, and a row of null term for each document, with its length.
    """
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("len", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, row, size, positions = [], [], [], []
            for k, t in enumerate(batch.column(1)):
                tokens = X.fold_tokens(t.as_py() or "")
                here = [w for w in terms if w in tokens]
                found += [None, *here]
                row += [k] * (1 + len(here))
                size += [len(tokens)] * (1 + len(here))
                positions.append([])
                positions += [[i for i, x in enumerate(tokens) if x == w] for w in here]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(row, pa.int32())), pa.array(size, pa.int32()), pa.array(positions, pa.list_(pa.int32()))], names=schema.names)

    both = session.cut(rows.mapInArrow(run, schema))
    return both.where("term is not null"), both.where("term is null").agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))


def statistics(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row: documents, tokens. Documents without tokens count."""
    tokens = index.agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("tokens"))
    return docs.agg(F.count("*").alias("docs")).crossJoin(F.broadcast(tokens))  # one row each


def _phrase_hits(found: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(phrase, id, len, f): how often each phrase occurs. All phrases of one token come from one scan of the postings."""
    single: dict[str, list[int]] = defaultdict(list)
    for k, p in enumerate(phrases):
        if len(p) == 1:
            single[p[0]].append(k)
    out = None
    if single:
        which = F.create_map(*(x for t, ks in single.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))))
        out = found.where(F.col("term").isin(list(single))).select(F.explode(F.element_at(which, F.col("term"))).alias("phrase"), "id", "len", F.size("positions").alias("f"))
    for k, p in enumerate(phrases):
        if len(p) == 1:
            continue
        hits = None
        for j, term in enumerate(p):
            at = found.where(F.col("term") == term).select("id", "len", F.transform("positions", lambda x: x - j).alias("starts"))
            hits = at if hits is None else hits.join(at.select("id", F.col("starts").alias("more")), "id").select("id", "len", F.array_intersect("starts", "more").alias("starts"))
        hits = hits.select(F.lit(k).alias("phrase"), "id", "len", F.size("starts").alias("f")).where("f > 0")
        out = hits if out is None else out.unionByName(hits)
    return out


def bm25(index: DataFrame, stats: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, score) of the documents that have any phrase; lower is better. A phrase given twice counts twice.

    The terms are pushed down to the postings' scan; everything after works on their few postings, which are written
    once: how many documents a phrase has (a row for each phrase) and the scores come from that.
    """
    hits = session.cut(_phrase_hits(index.where(F.col("term").isin(sorted({t for p in phrases for t in p}))), phrases))
    total = stats.first()
    weights = [F.lit(x) for r in hits.groupBy("phrase").agg(F.count("*").alias("n")).collect() for x in (r.phrase, _idf(total.docs, r.n))]
    idf = F.element_at(F.create_map(*weights), F.col("phrase")) if weights else F.lit(0.0)
    return hits.groupBy("id").agg((-F.sum(_gain(idf, F.col("f"), total.tokens / max(1, total.docs)))).alias("score"))


def _idf(docs: int, n: int) -> float:
    idf = math.log((docs - n + 0.5) / (n + 0.5))
    return idf if idf > 0 else 1e-6


def _gain(idf: Column | float, f: Column, mean: float) -> Column:
    """What a document of ``len`` tokens gets for f occurrences."""
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / (mean or 1.0)))


def term_counts(docs: DataFrame, id_col: str, text: Column, terms: list[str]) -> DataFrame:
    """(id, len, f): the document's tokens, and how often it has each of ``terms``."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("len", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f = [], []
            for t in batch.column(1).to_pylist():
                tokens = X.fold_tokens(t or "")
                size.append(len(tokens))
                f.append([tokens.count(w) for w in terms])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(f, pa.list_(pa.int32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def scan_bm25(docs: DataFrame, id_col: str, text: Column, terms: list[str]) -> DataFrame:
    """bm25 straight from the texts, without an index: one scan counts only the query's terms.

    The counts, a few numbers for each document, are written once; the corpus statistics and the scores come from them.
    """
    counted = session.cut(term_counts(docs, id_col, text, terms))
    f = [F.get("f", F.lit(k)) for k in range(len(terms))]
    total = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *(F.count_if(x > 0).alias(f"n{k}") for k, x in enumerate(f))).first()
    score = F.lit(0.0)
    for k, x in enumerate(f):
        score = score - _gain(F.lit(_idf(total.docs, total[f"n{k}"])), x, total.mean)
    return counted.where(F.exists("f", lambda n: n > 0)).select("id", score.alias("score"))


def dot(vector: Column, query: list[float]) -> Column:
    """The dot product of each vector with ``query``: one product for a batch, in double; null where lengths differ."""
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def product(v: pa.Array) -> pa.Array:
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(v), len(q)), False))
        out = np.zeros(len(v))
        flat = np.asarray(pc.fill_null(v.filter(pa.array(fits)).flatten(), np.nan), dtype=np.float64)
        out[fits] = flat.reshape(-1, len(q)) @ q if len(q) else 0.0
        return pa.array(out, mask=~fits)

    return product(vector)


@F.arrow_udf(T.DoubleType())
def norm(v: pa.Array) -> pa.Array:
    """The length of each vector."""
    count = np.asarray(pc.fill_null(pc.list_value_length(v), 0)).astype(np.int64)
    square = np.square(np.asarray(v.flatten(), dtype=np.float64))
    total = np.concatenate([[0], np.cumsum(square)])[np.concatenate([[0], np.cumsum(count)])]
    return pa.array(np.sqrt(np.diff(total)), mask=~np.asarray(v.is_valid()))


def cosine(vectors: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """Adds ``raw_sim``; the vectors have length 1."""
    return vectors.withColumn("raw_sim", dot(F.col(vector), query))


def ranked(rows: DataFrame, order: list[Column], most: int, name: str) -> DataFrame:
    """The first ``most`` rows with their rank. The limit comes first: each task keeps ``most`` rows at most."""
    return rows.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(lexical: DataFrame, vector: DataFrame, on: str = "id") -> DataFrame:
    """Full outer join of ranked rows (lex_rank; vec_rank) and ``score``, the sum of 1 / (60 + rank)."""
    score = sum((F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0)) for r in ("lex_rank", "vec_rank")), F.lit(0.0))
    return lexical.join(vector, on, "full_outer").withColumn("score", score)


def hybrid(sections: DataFrame, index: DataFrame, stats: DataFrame, query: str, query_vector: list[float] | None, model: str, chunking: str, limit: int = 10) -> DataFrame:
    """Search results (``schemas.RESULT`` and id). Without word characters there is no lexical leg, without a vector no other."""
    spark = sections.sparkSession
    phrases = X.query_phrases(query)
    if phrases:
        lex = ranked(bm25(index, stats, phrases), [F.col("score"), F.col("id")], POOL, "lex_rank").select("id", "lex_rank")
    else:
        lex = spark.createDataFrame([], "id string, lex_rank int")
    if query_vector is not None:
        valid = sections.where(F.col("vector").isNotNull() & (F.col("embedding_model") == model) & (F.col("chunking_version") == chunking))
        near = cosine(valid.select("id", "vector"), query_vector).select("id", "raw_sim")
        vec = ranked(near, [F.col("raw_sim").desc(), F.col("id")], POOL, "vec_rank")
    else:
        vec = spark.createDataFrame([], "id string, raw_sim double, vec_rank int")
    top = fuse(lex, vec).orderBy(F.col("score").desc(), "id").limit(limit)

    @F.pandas_udf(T.StringType())
    def marked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else X.snippet(t, phrases))

    rows = sections.select("id", "path", "heading", "start_line", "text").join(F.broadcast(top), "id")  # at most `limit` rows
    rows = rows.withColumn("snippet", marked(F.when(F.col("lex_rank").isNotNull(), F.col("text"))))
    return rows.orderBy(F.col("score").desc(), "id").select("id", "path", "heading", "start_line", "score", "lex_rank", "vec_rank", "raw_sim", "snippet")


def duplicate_candidates(titles: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """Titles (path, title_rank) and search results (path, raw_sim, rank) joined by path and ordered as evidence.

    A path's best result is the one of highest similarity, where none (or 0) counts as -1, the first one among equals.
    """
    sim = F.when(F.col("raw_sim").isNull() | (F.col("raw_sim") == 0), -1.0).otherwise(F.col("raw_sim"))
    best = results.withColumn("sim", sim).withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(F.col("sim").desc(), "rank"))).where("nth = 1").drop("nth")
    both = titles.join(best, "path", "full_outer").withColumn("sim", F.coalesce("sim", F.lit(-1.0)))
    return both.orderBy(F.col("title_rank").isNull(), F.coalesce("title_rank", F.lit(999)), F.col("sim").desc(), "path").limit(most).select("path", "title_rank", "raw_sim")


Embedder = Callable[[list[str]], "list[list[float]]"]


def embed(sections: DataFrame, embedder: Embedder, dimensions: int, batch: int = 128) -> DataFrame:
    """(id, sha256, vector): unit vectors of the texts, ``batch`` of them at a call, in Arrow-fed workers.

    ``embedder`` maps texts to vectors and is sent to the workers; a vector of another length is an error.
    """

    def run(batches):
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                m = np.asarray(embedder(part.text.tolist()), dtype=np.float32)
                if m.shape != (len(part), dimensions):
                    raise ValueError(f"expected vectors of {dimensions} numbers, got {m.shape}")
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({"id": part.id, "sha256": part.sha256, "vector": list(m / np.where(norm > 0, norm, 1))})

    return sections.select("id", "sha256", "text").mapInPandas(run, "id string, sha256 string, vector array<float>")


def filler(embedder: Embedder, dimensions: int, keep: Callable[[pa.Array, pa.Array], None], every: int, batch: int = 128) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a task: its rows (text, sha256, vector and others), in their order, with a unit vector wherever there was none.

    It is one pass, however many vectors are made: a task hands (hashes, vectors) to ``keep`` each time that it has made
    ``every`` of them, and at its end, so what breaks off has lost fewer than that of each task. A task that is run
    again keeps some twice, which readers, who go by hash, don't mind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, made = [], []

        def flush() -> None:
            if hashes:
                keep(pa.concat_arrays(hashes), pa.concat_arrays(made))
                hashes.clear()
                made.clear()

        for whole in batches:
            text, sha, vector = (whole.schema.get_field_index(c) for c in ("text", "sha256", "vector"))
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                todo = b.filter(b.column(vector).is_null())
                if todo.num_rows:
                    new = _unit_vectors(embedder(todo.column(text).to_pylist()), todo.num_rows, dimensions).cast(b.schema.field(vector).type)
                    for k in range(0, len(new), every):
                        hashes.append(todo.column(sha).slice(k, every))
                        made.append(new.slice(k, every))
                        if sum(map(len, made)) >= every:
                            flush()
                    gone = np.asarray(b.column(vector).is_null())
                    order = np.where(gone, len(b) + np.cumsum(gone) - 1, np.arange(len(b)))
                    b = b.set_column(vector, b.schema.field(vector), pa.concat_arrays([b.column(vector), new]).take(pa.array(order)) if todo.num_rows < len(b) else new)
                yield b
        flush()

    return run


def _unit_vectors(vectors: list[list[float]], count: int, dimensions: int) -> pa.ListArray:
    m = np.asarray(vectors, dtype=np.float32)
    if m.shape != (count, dimensions):
        raise ValueError(f"expected vectors of {dimensions} numbers, got {m.shape}")
    size = np.linalg.norm(m, axis=1, keepdims=True)
    flat = (m / np.where(size > 0, size, 1)).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * dimensions, pa.int32()), pa.array(flat))


def providers(available: list[str] | None = None) -> list[str]:
    """ONNX providers by preference: CUDA, DirectML, CPU; those that are there."""
    if available is None:
        try:
            import onnxruntime

            available = onnxruntime.get_available_providers()
        except ImportError:
            available = []
    order = [p for p in ("CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider") if p in available]
    return order or ["CPUExecutionProvider"]
