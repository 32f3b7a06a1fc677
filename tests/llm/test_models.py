"""Quality and language models: held-out accuracy, exact pieces against plain versions, hard rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomnote.llm import langid, quality, spans

D = "/root/testdata/sf0.01"
LANGS = {"en": "the of and to in that with for was this have from they been which", "de": "der die und nicht ein das mit sich auf für sie dem von auch werden", "fr": "le la les une dans que pour pas avec sur être nous vous cette mais"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def labelled(seed=0, n=200):
    rng = random.Random(seed)
    good = [sentence(rng, rng.choice([*LANGS]), rng.randrange(5, 60)) for _ in range(n)]
    bad = [" ".join(w + rng.choice(("!!", "###", "$$$")) for w in sentence(rng, "en", rng.randrange(5, 60)).split()) for _ in range(n // 3)]
    bad += [" ".join([rng.choice(("spam", "zzz", "qqq"))] * 20) for _ in range(n // 6)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad]
    rng.shuffle(rows)
    return rows


def plain_score(m, text):
    """The score gram by gram."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    if not words:
        return None
    h = [int(spans.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in words]
    shift = 64 - quality.BITS
    total = m.intercept + np.mean([m.weights[0][x >> shift] for x in h], dtype=float)
    if len(h) > 1:
        pair = []
        for a, b in zip(h, h[1:]):
            x = int(quality._SAME) << 32 if a == b else int(spans.mix(np.array([(a * 3 + b) % 2**64], dtype=np.uint64))[0])
            pair.append(m.weights[1][x >> shift])
        total += np.mean(pair, dtype=float)
    chars = []
    for k in (2, 3, 4):
        for i in range(len(data) - k + 1):
            g = int.from_bytes(data[i : i + k].tobytes(), "big")
            g = ((g * 0x9E3779B1 + k) % 2**32 * 0x85EBCA6B) % 2**32 >> (32 - quality.BITS)
            chars.append(m.weights[2][g])
    return total + (np.mean(chars, dtype=float) if chars else 0.0)


def test_quality_scores_are_those_of_a_plain_version():
    rows = labelled()
    m = quality.fit([t for t, _ in rows], [y for _, y in rows])
    texts = ["a", "a a", "the of", "x", "", "the  of and !! ###", "é ñ ü", "voilà Россия à Р", "中\u3000文 à\u00a0b", "x\u2009y\u2028z\u205fw\u1680v\u0085u", "\u2003", *[t for t, _ in rows[:30]], "the " * 5000]
    got, some = m.raw(pa.array(texts))
    for t, s, ok in zip(texts, got, some):
        want = plain_score(m, t)
        assert (want is not None) == ok
        if ok:
            assert s == pytest.approx(want, abs=1e-3)


def test_quality_held_out():
    rows, test = labelled(0), labelled(1)
    m = quality.fit([t for t, _ in rows], [y for _, y in rows])
    p = m.probability(pa.array([t for t, _ in test]))
    y = np.array([y for _, y in test])
    assert (p[y == 1] >= quality.KEEP).mean() > 0.98 and (p[y == 0] < quality.KEEP).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.08  # calibrated


def test_quality_on_the_tables(spark):
    import os

    if not os.path.isdir(D):
        pytest.skip("the test tables aren't here")
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    m = quality.train(docs, labels, sample=250)
    seen = set(quality.training_rows(docs, labels, sample=250)[0])
    assert len(seen) == 250
    truth = {r.doc_id: r.quality for r in labels.join(docs, "doc_id").collect() if r.text not in seen}
    got = {r.doc_id: r.kept for r in quality.score(docs, m).collect()}
    good = [got[i] for i, q in truth.items() if q]
    bad = [got[i] for i, q in truth.items() if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_quality_hard_rows(spark):
    docs = spark.createDataFrame([(1, "the of", 0.1), (1, "the of", 0.2), (None, "the of", 0.3), (2, None, 0.4), (3, "", 0.5), (4, " \n", 0.6), (5, "the " * 100_000, 0.7)], "doc_id long, text string, probability double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (77, 0)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    assert m.weights is None and m.prior == pytest.approx(2 / 3)  # two rows of one text, which counts once
    rows = quality.score(docs, m).collect()
    assert sorted(((r.doc_id, r.probability, r.kept) for r in rows), key=repr) == sorted([(1, m.prior, True), (1, m.prior, True), (None, m.prior, True), (2, 0.0, False), (3, 0.0, False), (4, 0.0, False), (5, m.prior, True)], key=repr)
    kept = quality.filter_quality(docs, m)
    assert kept.schema == docs.schema and sorted(r.probability for r in kept.collect()) == [0.1, 0.2, 0.3, 0.7]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_sample_keeps_long_texts_and_ignores_copies(spark):
    """Long labelled texts train, copies take no places, labels without texts neither; few rows train too."""
    long = [(i, f"word{i} " * 40_000, 1) for i in range(10)]
    short = [(100 + i, f"spam{i} !!", 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in long + short] + [(100, short[0][1])] * 1000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in long + short] + [(5000 + i, i % 2) for i in range(300)], "doc_id long, quality int")
    texts, y = quality.training_rows(docs, labels)
    assert sorted(texts) == sorted(t for _, t, _ in long + short) and sum(y) == 10
    some, _ = quality.training_rows(docs, labels, sample=12)
    assert len(some) == len(set(some)) == 12
    few, _ = quality.training_rows(docs, labels, sample_chars=1)
    assert len(few) == 1
    m = quality.train(docs, labels)
    assert m.weights is not None
    p = m.probability(pa.array([long[3][1], short[4][1]]))
    assert p[0] > 0.5 > p[1]
    two = quality.fit(["good words here", "bad !! !!"], [1, 0])
    assert two.weights is not None and np.argmax(two.probability(pa.array(["bad !! !!", "good words here"]))) == 1
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    got = quality.training_rows(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), both)
    assert dict(zip(*got)) == {"a": 0, "b": 1}


def plain_viterbi(score, switch):
    v, back = np.zeros(score.shape[1]), []
    for row in score.astype(float):
        top = int(v.argmax())
        back.append([c if v[c] >= v[top] - switch else top for c in range(len(v))])
        v = np.maximum(v, v[top] - switch) + row
    c, out = int(v.argmax()), []
    for b in back[::-1]:
        out.append(c)
        c = b[c]
    return out[::-1]


def path_value(score, path, switch):
    return sum(score[i, c] for i, c in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("block", [4, 16, 256])
def test_viterbi_is_the_plain_one(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(20):
        count = rng.integers(0, 90, 12)
        at = np.concatenate([[0], np.cumsum(count)])
        score = rng.normal(size=(at[-1], 4)).astype(np.float32) * 4
        got = langid.viterbi(score, at, 6.0)
        for a, b in zip(at, at[1:]):
            if b > a:
                s = score[a:b]
                assert path_value(s, got[a:b].tolist(), 6.0) == pytest.approx(path_value(s, plain_viterbi(s, 6.0), 6.0), abs=1e-2)


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(5)
    rows = [(sentence(rng, x, 60), x) for x in LANGS for _ in range(40)]
    return langid.fit([t for t, _ in rows], [x for _, x in rows])


def test_spans_of_mixed_text(spark, languages):
    rng = random.Random(9)
    docs, want = [], {}
    for i in range(60):
        parts = [(x, rng.randrange(12, 40)) for x in rng.sample([*LANGS], rng.randrange(1, 4))]
        docs.append((i, " ".join(sentence(rng, x, n) for x, n in parts), "zz"))
        want[i] = [x for x, n in parts for _ in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang_found string")
    right = total = 0
    for r in langid.detect(df, languages).collect():
        got, a = [], 0
        for x, b in zip(r.span_langs, r.span_ends):
            got += [x] * (b - a)
            a = b
        assert len(got) == r.n_words == len(want[r.doc_id]) and all(x != y for x, y in zip(r.span_langs, r.span_langs[1:]))
        assert r.share == pytest.approx(Counter(got)[r.lang_found] / len(got))
        right += sum(x == y for x, y in zip(got, want[r.doc_id]))
        total += len(got)
    assert right / total > 0.97


def test_scripts_and_hard_rows(spark, languages):
    texts = {1: "Привет как дела", 2: "你好世界 你好", 3: "こんにちは 世界です", 4: "שלום עולם", 5: "the of and Привет как дела друзья мои", 6: "123 456", 7: None, 8: "", 9: "... !!", 10: "xqzjk wvvqx zzqxj qqqxw vvxzq jjqxz wwqzx", 11: "der die und 12 34 nicht", 12: "the of and " * 40_000}
    df = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, texts[11])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.detect(df, languages).collect()}
    assert {i: got[i].lang_found for i in texts} == {1: "ru", 2: "zh", 3: "ja", 4: "he", 5: "ru", 6: "und", 7: None, 8: None, 9: None, 10: "und", 11: "de", 12: "en"}
    assert got[5].span_langs == ["en", "ru"] and got[5].span_ends == [3, 8] and got[11].span_ends == [6]
    assert got[12].n_words == 120_000 and got[12].span_ends == [120_000] and got[7].span_langs == []
    assert langid.detect(df.limit(0), languages).count() == 0
    kept = langid.filter_language(df, languages)
    assert sorted(((r.doc_id or 0) for r in kept.collect())) == [0, 1, 1, 2, 3, 4, 5, 11, 12] and kept.schema == df.schema
    assert [r.doc_id for r in langid.filter_language(df, languages, allowed=["he"]).collect()] == [4]
    none = langid.fit([], [])
    assert langid.detect(df.where("doc_id = 1"), none).first().lang_found == "ru"


def test_language_held_out(spark):
    import os

    if not os.path.isdir(D):
        pytest.skip("the test tables aren't here")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    m = langid.train(docs, sample=50)
    rows = langid.detect(docs, m).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_found for r in rows]) > 0.98


def test_copies_take_no_place_in_the_training_sample(spark):
    texts = [f"the of and number {i}" for i in range(20)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    first = docs.orderBy(langid.F.xxhash64("text")).first().text
    seen = [r.text for r in langid.sampled(docs.union(spark.createDataFrame([(first, "en")] * 300, docs.schema)), sample=10).collect()]
    assert len(seen) == len(set(seen)) == 10


def test_training_in_tasks_is_that_on_the_driver(spark):
    """Long texts train like others; the sums of the tasks are the counts of all texts."""
    rng = random.Random(3)
    rows = [(sentence(rng, x, n), x) for x in LANGS for n in (5, 300, 60_000)] + [("", "en"), (None, "de"), ("abc", None), ("und so", "und")]
    m = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    want = langid.fit([t for t, x in rows if t and x], [x for t, x in rows if t and x])
    assert m.languages == want.languages and np.array_equal(m.table, want.table) and m.floor == want.floor and np.array_equal(m.candidates, want.candidates)


@pytest.mark.parametrize("moves", [1 << 23, 40_000])
def test_many_languages(spark, monkeypatch, moves):
    """More labels than a byte holds, in short and long texts."""
    monkeypatch.setattr(langid, "MOVES", moves)
    names = [f"x{i:03d}" for i in range(200)]
    words = {x: [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}{'qzj'[j]}{chr(97 + i % 26)}" for j, k in enumerate(("ab", "oc", "ed"))] for i, x in enumerate(names)}
    m = langid.fit([" ".join(words[x] * 20) for x in names], names)
    docs = [(i, " ".join(words[x] * n)) for i, (x, n) in enumerate([(names[3], 10), (names[150], 10), (names[199], 400)])]
    docs.append((3, " ".join(words[names[190]] * 150 + words[names[7]] * 300)))
    got = {r.doc_id: r for r in langid.detect(spark.createDataFrame(docs, "doc_id long, text string"), m).collect()}
    assert [got[i].lang_found for i in range(3)] == [names[3], names[150], names[199]]
    assert got[3].span_langs == [names[190], names[7]] and got[3].span_ends == [450, 1350]


def test_scripts_that_have_no_model(spark, languages):
    """Letters of other scripts are theirs, or of no language; never the language around them."""
    telugu = "\u0c24\u0c46\u0c32\u0c41\u0c17\u0c41"
    runic = "\u16a0\u16a1\u16a2\u16a3"
    texts = {1: "the of and to in that " + " ".join([telugu] * 6), 2: " ".join([runic] * 6) + " the of and to in that with for", 3: "\u1230\u120b\u121d", 4: "\u0ab6\u0ac1", 5: "\u179a\u1794", 6: "日本語 は 世界 の 言語 です", 7: "世界 言語", 8: "the of \U0001f642 and"}
    got = {r.doc_id: r for r in langid.detect(spark.createDataFrame([*texts.items()], "doc_id long, text string"), languages).collect()}
    assert (got[1].span_langs, got[1].span_ends) == (["en", "te"], [6, 12]) and (got[2].span_langs, got[2].span_ends) == (["und", "en"], [6, 14])
    assert [got[i].lang_found for i in (3, 4, 5, 6, 7, 8)] == ["am", "gu", "km", "ja", "zh", "en"]
    both = langid.fit(["日本 語 世界 です は の ました " * 20, "中国 的 是 我们 这个 " * 20], ["ja", "zh"])
    assert both.candidates[langid.NAMES.index("Hani")].sum() == 3  # ja, zh and und
