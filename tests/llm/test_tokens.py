"""BPE, token counts and DAC blobs against independent versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
regex = pytest.importorskip("regex")

from loomnote.llm import bpe, dac, spans, tokencount  # noqa: E402

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
TEXTS = ["it's 'tis he'll 'she d'd  x\n\n y's z   ", "\n's 're 've' 'vex'really''s", "a　　b   c", "  ", "", "x'", "'", "é's É'llo 12ab ½²x", "'s's'll", " '", "Привет мир 你好，世界 🙂🙂", "<|endoftext|>", "a" * 5000, "the " * 3000, None]


@pytest.fixture(scope="module", params=FILES)
def vocab(request):
    path = public_tokenizers.path(request.param)
    v = bpe.Vocab(bpe.read_ranks(path))
    return path, v, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ids, special_tokens={})


def fuzz(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("ab thesñé'sdl0 1\n\t!.,-_你и ") for _ in range(r.randrange(60))) for _ in range(n)]


def test_pretokens():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t or "" for t in TEXTS] + fuzz(1)
    for i, j, data, offsets in spans.chunks(pa.array(texts), 2000):
        starts = spans.pretokens(data, offsets)
        for r in range(i, j):
            mine = starts[(starts >= offsets[r - i]) & (starts < offsets[r - i + 1])] - offsets[r - i]
            want, at = [], 0
            for m in pattern.findall(texts[r]):
                want.append(at)
                at += len(m.encode())
            assert mine.tolist() == want, texts[r]


def merge_by_merge(v, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((v.ids.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return [v.ids[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_encoder_is_exact(vocab):
    _, v, library = vocab
    r = random.Random(2)
    for _ in range(1500):
        piece = "".join(r.choice("abcdetonisr ñé0") for _ in range(r.randrange(1, 25))).encode()
        assert v.encode_piece(piece) == merge_by_merge(v, piece) == library._encode_single_piece(piece)
    assert v.encode_piece(b"a" * 50_000) == library._encode_single_piece(b"a" * 50_000)


def test_every_token_is_reached_alone_and_decodes(vocab):
    _, v, _ = vocab
    for i in range(0, len(v.tokens), 7):
        assert v.encode_piece(v.tokens[i]) == [i]
    ids = np.arange(len(v.tokens))
    assert v.decode(ids) == b"".join(v.tokens) and v.decode(np.zeros(0, dtype=np.int64)) == b""


def frame(spark, texts):
    rows = [(i % 7 if i % 11 else None, t, "clash", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string, n_tokens double")  # names that clash with the results'


def test_encode_decode_count_dac(spark, vocab):
    path, v, library = vocab
    texts = TEXTS + fuzz(3, 60) + TEXTS
    docs = frame(spark, texts)
    want = sorted(((i % 7 if i % 11 else -1, None if t is None else library.encode_ordinary(t)) for i, t in enumerate(texts)), key=repr)
    rows = bpe.encode(docs, path).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.tokens) for r in rows), key=repr) == want
    assert all((r.n_tokens, r.n_bytes_back) == (None, None) if r.tokens is None else r.n_tokens == len(r.tokens) and r.n_bytes_back >= 0 for r in rows)
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(map(repr, (r.text for r in back))) == sorted(map(repr, texts))
    counts = tokencount.count_tokens(docs, path).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in counts), key=repr) == sorted(((i, None if t is None else len(t)) for i, t in want), key=repr)
    pattern = regex.compile(public_tokenizers.PATTERN)
    whole = {t for t in v.tokens if pattern.findall(t.decode("utf-8", "replace")) == [t.decode("utf-8", "replace")] and library._encode_single_piece(t) == [v.ids[t]]}
    alone = sorted(((i % 7 if i % 11 else -1, None if t is None else sum(p.encode() in whole for p in pattern.findall(t))) for i, t in enumerate(texts)), key=repr)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_whole) for r in counts), key=repr) == alone
    blobs = dac.write_tokens(docs, path).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, None if r.dac is None else dac.Reader(bytes(r.dac)).all().tolist()) for r in blobs), key=repr) == want
    assert all(r.n_tokens == (None if r.dac is None else len(dac.Reader(bytes(r.dac)))) for r in blobs)
    for op in (bpe.encode, tokencount.count_tokens, dac.write_tokens):
        assert op(docs.limit(0), path).count() == 0


def test_decode_hard_rows(spark, vocab):
    path, v, library = vocab
    text = "it's été 你好 🙂"
    ids = library.encode_ordinary(text)
    cut = next(k for k in range(1, len(ids)) if "\ufffd" in v.decode(np.array(ids[:k])).decode("utf-8", "replace"))
    lists = {1: ids, 2: [], 3: None, 4: [5, None], 5: [-2], 6: [len(v.tokens)], 7: [7, 8] * 100_000, 8: ids[:cut], 9: [1 << 40]}
    df = spark.createDataFrame([(i, x, "n", 0) for i, x in lists.items()] + [(None, ids, "n", 0)], "doc_id long, tokens array<long>, text string, n_bad int")
    rows = bpe.decode(df, path).collect()
    got = {r.doc_id: (r.text, r.n_bad) for r in rows}
    assert got[None] == got[1] == (text, 0) and got[2] == ("", 0) and got[3] == (None, None)
    assert [got[i] for i in (4, 5, 6, 9)] == [(None, 1)] * 4
    assert got[7] == (library.decode(lists[7]), 0) and got[8] == (v.decode(np.array(ids[:cut])).decode("utf-8", "replace"), 0)
    assert bpe.decode(df.limit(0), path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 255, 256, 65536, 1 << 31])
def test_dac_access(n, top):
    ids = np.random.default_rng(n + top % 1000).integers(0, top, n, dtype=np.int64)
    if n > 3:
        ids[2] = top
    r = dac.Reader(dac.encode(ids))
    assert len(r) == n and r.all().tolist() == ids.tolist()
    assert [r[i] for i in range(0, n, max(1, n // 300))] == ids[:: max(1, n // 300)].tolist()
    with pytest.raises(IndexError):
        r[n]


def test_dac_pick_and_errors(spark):
    rows = spark.createDataFrame([(bytearray(dac.encode(np.array([5, 70000, 3]))), 1), (bytearray(dac.encode(np.array([5]))), 1), (None, 0)], "dac binary, i long")
    assert [r.token for r in dac.pick(rows, "i").collect()] == [70000, None, None]
    with pytest.raises(ValueError):
        dac.encode(np.array([-1]))
    with pytest.raises(ValueError):
        dac.Reader(b"none")


def test_cache_is_bounded(vocab):
    _, v, library = vocab
    cache = bpe.PieceCache(v.encode_piece, most=50)
    texts = fuzz(5, 100)
    out = []
    for _, _, ids, at in bpe.tokenize(pa.array(texts), cache):
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert out == [library.encode_ordinary(t) for t in texts]


def test_whole_tokens_are_proved(vocab):
    _, v, _ = vocab
    pattern = regex.compile(public_tokenizers.PATTERN)
    alone = [t for i, t in enumerate(v.tokens) if tokencount._is_text(t) and pattern.findall(t.decode()) == [t.decode()] and v.encode_piece(t) == [i]]
    want = sorted(int(spans.span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in alone)
    assert tokencount.whole_hashes(v).tolist() == want and 0.9 * len(v.tokens) < len(want) <= len(v.tokens)
