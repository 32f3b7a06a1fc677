"""The pipeline: each stage against planted rows, and the whole run against plain versions of its four stages."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from loomnote.llm import bpe, langid, packing, quality, queries, simhash  # noqa: E402
from tests.llm.test_models import plain_score, plain_viterbi  # noqa: E402
from tests.llm.test_simhash import components  # noqa: E402

VOCAB = {"en": ["the", "of", "and", "with"], "de": ["der", "und", "nicht", "mit"]}
STEMS = [f"{a}{b}{c}" for a in ("ber", "lin", "tor", "van", "kel") for b in ("a", "o", "e") for c in ("ting", "lich", "mond", "ser", "nat", "gul")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(8), str(tmp_path_factory.mktemp("tables"))

    def text(lang, n):
        return " ".join(rng.choice(VOCAB[lang] if rng.random() < 0.5 else STEMS) + str(rng.choice(("", "s", "en"))) for _ in range(n))

    rows, label = [], []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        rows.append((i, text(lang, rng.choice((90, 150, 151, 400))), lang))
        label.append((i, 1))
    for i in range(160, 220):
        rows.append((i, " ".join(w + rng.choice(("!!", "%%%")) for w in text("en", 80).split()), "en"))
        label.append((i, 0))
    base = rows[3][1].split()
    rows.append((500, " ".join(base), "en"))
    rows.append((501, " ".join([*base[:40], "changed", *base[41:]]), "en"))
    rows += [(600, None, "en"), (601, "", None), (None, rows[4][1], "de"), (3, rows[3][1], "en"), (602, " \u00a0\n", "en"), (603, text("en", 30_000), "en")]
    rows += [(700 + i, " ".join(rng.choice(("xqzjk", "wvvqx", "zzqxj", "qqqxw")) for _ in range(60)), None) for i in range(5)]
    docs = spark.createDataFrame([(i, t, x, "src", len(t or ""), "k") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, gid string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in label], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "packing"]
    now = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, now, tables)
        assert nxt.columns == now.columns
        rows = nxt.collect()
        kept.append([r.doc_id for r in rows])
        now = spark.createDataFrame(rows, now.schema)
    clean = set(range(160)) | {500, 501, 603, None}
    assert clean <= set(kept[0]) <= clean | set(range(700, 705)) and kept[0].count(3) == 2
    assert set(kept[1]) == clean
    # exact and near copies go; of (None, 4) the null id is first
    assert sorted(kept[2], key=repr) == sorted([*(set(range(160)) - {4}), 603, None], key=repr)
    empty = now.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


def plain_run(spark, folder):
    """(id, tokens, padded to, padding) of each row that is left, one row and one pair at a time; least padding of any choice of buckets."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.collect()
    m = quality.train(docs, labels)
    rows = [r for r in rows if (s := plain_score(m, r.text or "")) is not None and 1 / (1 + math.exp(-(m.a * s + m.b))) >= quality.KEEP]
    lang = langid.train(spark.createDataFrame(rows, docs.schema))
    stay = []
    for r in rows:
        words = langid.Words(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        label = Counter(lang.languages[c] for c in plain_viterbi(lang.scores(words), langid.SWITCH))
        main, n = min(label.items(), key=lambda x: (-x[1], lang.languages.index(x[0])))
        if main != langid.UND and n >= 0.3 * sum(label.values()):
            stay.append(r)
    fp, some = simhash.fingerprints(pa.array([r.text for r in stay]))
    assert some.all()
    near = [(i, j) for i, j in itertools.combinations(range(len(stay)), 2) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.MAX_DISTANCE]
    group = components(len(stay), near)
    first = {}
    for g, r in sorted(zip(group, stay), key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0)):
        first.setdefault(g, r)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocab(bpe.read_ranks(queries.ranks_path())).ids, special_tokens={})
    sizes = [(r.doc_id, len(library.encode_ordinary(r.text))) for r in first.values()]
    h = sorted(Counter(n for _, n in sizes).items())
    # least[k][j]: padding of the first j lengths in at most k buckets
    least = [[0] + [math.inf] * len(h)]
    for _ in range(packing.BUCKETS):
        least.append([0] + [min(least[-1][i] + sum((h[j - 1][0] - n) * c for n, c in h[i:j]) for i in range(j)) for j in range(1, len(h) + 1)])
    return sizes, min(row[-1] for row in least)


def test_run_is_the_plain_one(spark, tables):
    plan = corpus_pipeline.run(spark, tables).collect()
    sizes, least = plain_run(spark, tables)
    assert Counter((r.doc_id, r.n_tokens) for r in plan) == Counter(sizes)
    assert sum(r.padding for r in plan) == least
    upper = sorted({r.padded_to for r in plan})
    assert len(upper) <= packing.BUCKETS and all(r.padded_to == next(u for u in upper if r.n_tokens <= u) and r.padding == r.padded_to - r.n_tokens for r in plan)
    for _, b in itertools.groupby(sorted(plan, key=lambda r: r.batch), key=lambda r: r.batch):
        b = list(b)
        assert len({r.padded_to for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].padded_to <= packing.BUDGET)
