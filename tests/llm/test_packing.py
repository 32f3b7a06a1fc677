"""Buckets against exhaustive search, batches against the budget."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from loomnote.llm import bpe, packing  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def padding(histogram, upper):
    return sum((next(u for u in upper if n <= u) - n) * c for n, c in histogram)


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(60), rng.randrange(1, 9))
        h = [(n, rng.randrange(1, 50)) for n in lengths]
        k = rng.randrange(1, 6)
        best = min(padding(h, sorted({*c, max(lengths)})) for c in itertools.combinations(lengths, min(k, len(lengths)) - 1))
        got = packing.boundaries(h, k)
        assert len(got) <= k and got[-1] == max(lengths) and padding(h, got) == best
    assert packing.boundaries([], 4) == [] and packing.boundaries([(5, 0)], 4) == []


@pytest.fixture(scope="module")
def library():
    ranks = bpe.Vocab(bpe.read_ranks(RANKS)).ids
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(rows, library, buckets, budget, shard):
    """(id, tokens, padded_to, padding) of each row, with the least padding that any choice of buckets has, and each bucket's batch sizes."""
    sizes = [(i, len(library.encode_ordinary(t or ""))) for i, t in rows]
    h = Counter(n for _, n in sizes)
    top = max(h)
    upper = min((sorted({*c, top}) for c in itertools.combinations(sorted(h), min(buckets, len(h)) - 1)), key=lambda u: padding(h.items(), u))
    out = [(i, n, u := next(u for u in upper if n <= u), u - n) for i, n in sizes]
    return out, {u: max(1, budget // max(1, u)) for u in upper}


def test_pack(spark, library):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice((3, 10, 11, 200))))) for i in range(500)] + [(1, "a b"), (1, "a b"), (None, "x, y"), (900, None), (901, ""), (902, "z " * 60_000), (903, "\u4e2d\u6587" * 1700)]
    rows += [(None, "")] * 333
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = packing.pack(docs, RANKS, buckets=4, budget=1000, shard=50).collect()
    want, size = brute(rows, library, 4, 1000, 50)
    assert sum(r.padding for r in got) == sum(w[3] for w in want)  # the least there is
    assert Counter((r.doc_id, r.n_tokens, r.padded_to, r.padding) for r in got) == Counter(want)
    batches = defaultdict(list)
    for r in got:
        batches[r.batch].append(r)
    short = Counter()
    for b in batches.values():
        u = b[0].padded_to
        assert {r.padded_to for r in b} == {u} and len(b) <= size[u] and (len(b) == 1 or len(b) * u <= 1000)
        short[u] += len(b) < size[u]
    shards = {u: len({r.batch.split("-")[1] for r in got if r.padded_to == u}) for u in size}
    assert all(short[u] <= shards[u] for u in size)
    assert max(Counter(r.batch.rsplit("-", 1)[0] for r in got).values()) < 333  # equal rows are in several shards
    sizes = {r.doc_id: r.n_tokens for r in got}
    assert sizes[902] > 50_000 and (sizes[901], sizes[900]) == (0, 0) and sizes[903] > 1700
    again = packing.pack(docs.repartition(7), RANKS, buckets=4, budget=1000, shard=50).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert packing.pack(docs.limit(0), RANKS).count() == 0
