"""Near-duplicates: recall against brute force, whole groups, hard rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomnote.llm import simhash


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=1, n=300):
    """(texts, group of each): some with near copies of up to 5 % of the words, some with exact ones."""
    rng, texts, group = random.Random(seed), [], []
    for g in range(n):
        base = words(rng, rng.randrange(60, 400))
        texts.append(" ".join(base))
        group.append(g)
        for _ in range(rng.choice((0, 0, 0, 1, 2, 5))):
            copy = [rng.choice(("x", "y", "z")) + w if rng.random() < 0.05 else w for w in base]
            texts.append(rng.choice((str, str.upper))(" ".join(copy)) if rng.random() < 0.7 else " ".join(base))
            group.append(g)
    return texts, group


def components(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_against_brute_force(spark):
    texts, group = corpus()
    fp, some = simhash.fingerprints(pa.array(texts))
    assert some.all()
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.MAX_DISTANCE]
    want = components(n, pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs).collect()]
    got = components(n, found)
    assert all(want[a] == want[b] for a, b in found)  # nothing that brute force doesn't connect
    recall = np.mean([got[a] == got[b] for a, b in pairs])
    assert recall >= 0.95
    planted = [(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j]]
    assert np.mean([got[a] == got[b] for a, b in planted]) >= 0.95
    assert all(group[a] == group[b] for a, b in found)
    deeper = [(r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs, depth=2).collect()]
    assert sorted(deeper) == sorted(found)
    kept = {r.doc_id for r in simhash.drop_duplicates(docs).collect()}
    assert kept == set(range(n)) - {a for a, _ in found}
    assert len({g for i, g in enumerate(group) if i in kept}) == len(set(group))


def test_isolated_pairs_by_distance(spark):
    """Pairs that no third copy links, with 8 to 14 % of their words changed: recall in each band up to the distance."""
    rng, texts = random.Random(4), []
    for k in range(900):
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice((60, 120, 200)))]
        copy = list(base)
        for i in rng.sample(range(len(base)), round(rng.uniform(0.08, 0.14) * len(base))):
            copy[i] = "x" + copy[i]
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    fp, _ = simhash.fingerprints(pa.array([t for _, t in texts]))
    distance = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1)
    found = {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    met = np.array([(2 * k + 1, 2 * k) in found for k in range(len(distance))])
    assert len(found) == met.sum() and (distance[met] <= simhash.MAX_DISTANCE).all()
    for low, high, least in ((0, 31, 1.0), (32, 39, 0.99), (40, 44, 0.98), (45, 48, 0.96)):
        band = (distance >= low) & (distance <= high)
        assert band.sum() >= 40 and met[band].mean() >= least, (low, high, band.sum(), met[band].mean())


def test_votes():
    rng = np.random.default_rng(2)
    count = np.array([1, 254, 255, 256, 1, 2000, 510])
    bits = rng.integers(0, 2, (count.sum(), 256), dtype=np.uint8)
    bits[1:600] = 1
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    assert np.array_equal(simhash._votes(bits, first, count), np.stack([bits[a : a + n].sum(axis=0, dtype=np.int32) for a, n in zip(first, count)]))


@pytest.mark.parametrize("distance, shared", [(28, 4), (29, 3), (20, 12)])
def test_a_guaranteed_minimum_is_found(spark, distance, shared):
    """Lone pairs at the distance that share just the bytes that any pair within it must share: all are found."""
    rng = np.random.default_rng(distance)
    fp = rng.integers(0, 256, (600, simhash.BYTES), dtype=np.uint8)
    for k in range(0, 600, 2):
        fp[k + 1] = fp[k]
        for p in rng.permutation(simhash.BYTES)[: simhash.BYTES - shared]:
            fp[k + 1, p] ^= np.uint8(1 << rng.integers(8))
    assert (np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1) == distance).all()
    nodes = spark.createDataFrame([(bytearray(x.tobytes()),) for x in fp], "fp binary")
    got = {(bytes(r.a), bytes(r.b)) for r in simhash.edges(nodes, max_distance=distance).collect()}
    assert got == {tuple(sorted((fp[k].tobytes(), fp[k + 1].tobytes()))) for k in range(0, 600, 2)}


def test_hot_list_of_near_copies():
    """Thousands of near copies in one list: all in one component, far fewer edges than pairs."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, simhash.BYTES, dtype=np.uint8)
    fp = np.repeat(base[None], 3000, axis=0)
    flip = rng.integers(4, simhash.BYTES, 3000)
    fp[np.arange(3000), flip] ^= rng.integers(1, 256, 3000).astype(np.uint8)
    fp = np.unique(fp, axis=0)
    where = np.arange(simhash.BYTES)[None]
    key = fp[:, 0].astype(np.int64) << 8 | fp[:, 1]
    a, b = simhash.link(key, fp, where)
    assert len(b) == len(fp) - 1 and len(set(components(len(fp), zip(a, b)))) == 1


def test_hard_rows(spark):
    long = " ".join(f"v{i % 9000}" for i in range(120_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, ""), (5, "!!"), (6, "!!"), (7, long), (8, long + " more"), (None, None), (9, "e f g h i j k")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, gid int")
    out = simhash.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text and r.text[:8]) for r in out.collect()), key=repr) == sorted(((None, "a b c d"), (3, None), (4, ""), (5, "!!"), (6, "!!"), (7, long[:8]), (None, None), (9, "e f g h ")), key=repr)
    dup = sorted(((r.doc_id, r.duplicate_of) for r in simhash.duplicates(docs).collect()), key=repr)
    assert dup == [(1, None), (1, None), (2, None), (8, 7)]
    assert simhash.duplicates(docs.limit(0)).count() == 0 and simhash.drop_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "two", "none"])
def test_components(spark, shape):
    pairs = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 30)], "two": [(1, 2), (2, 3), (7, 9), (8, 9)], "none": []}[shape]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    want = components(50, pairs)
    low = {}
    for i in range(50):
        low.setdefault(want[i], i)
    assert got == {i: low[want[i]] for p in pairs for i in p if low[want[i]] != i}
