"""Token counts with the whole-token shortcut.

Offline, once per worker, it is proved for each vocabulary string that it is one pre-token under the cutting pattern
and that the exact merges leave it whole. A pre-token that equals such a string counts as one token without any
merge; only the others are merged, each distinct one once (``bpe.CountCache``).

Strings are compared by a 64-bit hash; a false match would need a collision with one of about 50,000 hashes, about
3e-15 for a distinct pre-token.

Rows: a null text has a null count, an empty one 0. Very long texts are counted whole. Repeated rows and null ids are
counted like any other. An empty table gives no rows. A vocabulary without whole tokens counts by merges alone; one
that lacks a byte of a text can't encode it, which is an error. Only the id and the text column are read, so columns
with the names of results are safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote.llm import bpe, spans


def whole_hashes(vocab: bpe.Vocab) -> np.ndarray:
    """Sorted hashes of the vocabulary strings that are one pre-token and encode as one token.

    Tokens that are parts of characters are left out: no pre-token of a text is one.
    """
    texts = [i for i, t in enumerate(vocab.tokens) if vocab.alone(i) and _is_text(t)]
    data = np.frombuffer(b"".join(vocab.tokens[i] for i in texts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([vocab.lens[i] for i in texts])]).astype(np.int64)
    one = np.diff(np.searchsorted(spans.pretokens(data, begin), begin)) == 1
    proved = np.array([k for k in np.flatnonzero(one).tolist() if vocab.encode_piece(vocab.tokens[texts[k]]) == [texts[k]]], dtype=np.int64)
    return np.sort(spans.span_hashes(data, begin[proved], begin[proved + 1]))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_proved: dict[int, tuple[np.ndarray, bpe.CountCache]] = {}


def count_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_whole): tokens of each text, and how many of its pre-tokens took the shortcut."""
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_whole", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = bpe.worker_vocab(ranks.value)
        if id(vocab) not in _proved:
            _proved.clear()
            _proved[id(vocab)] = whole_hashes(vocab), bpe.CountCache(vocab.encode_piece)
        whole, cache = _proved[id(vocab)]
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            n = np.zeros((2, len(text)), dtype=np.int64)
            for i, j, data, offsets in spans.chunks(text, spans.CHUNK >> 1):
                starts = spans.pretokens(data, offsets)
                ends = np.append(starts[1:], len(data))
                h = spans.span_hashes(data, starts, ends)
                hit = whole[np.minimum(np.searchsorted(whole, h), len(whole) - 1)] == h if len(whole) else np.zeros(len(h), dtype=bool)
                rest = np.flatnonzero(~hit)
                count = hit.astype(np.int64)
                if len(rest):
                    count[rest] = cache.counts(data, starts[rest], ends[rest], h[rest])
                at = np.searchsorted(starts, offsets)
                for k, x in enumerate((count, hit)):
                    n[k, i:j] = np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
            none = ~np.asarray(text.is_valid())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[0], mask=none), pa.array(n[1], mask=none)], names=schema.names)

    return rows.mapInArrow(run, schema)
