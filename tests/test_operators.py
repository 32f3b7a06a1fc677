"""Operators on small fixtures: BM25 against a plain version, phrases, snippets, graph, logs, calls, streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomnote import schemas
from loomnote.functions import parse
from loomnote.functions import text as X
from loomnote.operators import events, graph, lifecycle, notes, search, sessions
from loomnote.sources import vault
from loomnote.streaming import ingest


def plain_bm25(docs, phrases):
    toks = {i: X.fold_tokens(t) for i, t in docs.items()}
    mean = sum(map(len, toks.values())) / len(toks)

    def f(t, p):
        return sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))

    out = {}
    for p in phrases:
        hits = {i: f(t, p) for i, t in toks.items() if f(t, p)}
        idf = math.log((len(toks) - len(hits) + 0.5) / (len(hits) + 0.5))
        for i, n in hits.items():
            out[i] = out.get(i, 0) - (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))
    return out


@pytest.mark.parametrize("q", ["beta", "foo_bar", "Café", "beta beta", "common", "gamma beta foo_bar", "!!"])
def test_bm25(spark, q):
    docs = {"1": "common beta foo bar", "2": "common bar foo cafe", "3": "common gamma foo_bar beta beta", "4": "common", "5": "", "6": "CAFÉ x y common z"}
    rows = spark.createDataFrame(list(docs.items()), "id string, t string")
    phrases = X.query_phrases(q)
    want = plain_bm25(docs, phrases)
    if not phrases:
        assert q == "!!"
        return
    index = search.postings(rows, "id", F.col("t"))
    got = search.bm25(index, search.statistics(rows, index), phrases)
    if all(len(p) == 1 for p in phrases):
        assert {r.id: r.score for r in search.scan_bm25(rows, "id", F.col("t"), [p[0] for p in phrases]).collect()} == pytest.approx(want)
    assert {r.id: r.score for r in got.collect()} == pytest.approx(want)


def test_snippet():
    text = " ".join(f"w{i}" for i in range(100)) + " Café au lait " + " ".join(f"v{i}" for i in range(100))
    s = X.snippet(text, [["cafe"]])
    assert "[Café]" in s and s.startswith("...") and s.endswith("...") and len(s.split()) <= 26
    assert X.snippet("foo_bar baz", [["foo", "bar"]]) == "[foo]_[bar] baz"
    assert X.snippet("", [["a"]]) == ""


def test_bad_file(spark):
    files = spark.createDataFrame([("a.md", None), ("b.md", bytearray(b"x [[c]]"))], schemas.FILES)
    parsed = notes.parse_files(files)
    assert [r.path for r in notes.errors(parsed).collect()] == ["a.md"]
    assert [r.path for r in notes.notes(parsed).collect()] == ["b.md"]


def test_chunks_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        words = ["".join(rng.choice("abcé_!") for _ in range(rng.choice((1, 3, 9, 30)))) for _ in range(rng.randrange(600))]
        got = parse.chunk_texts("h", " ".join(words))
        flat = " ".join(words).split()
        at = 0
        for k, c in enumerate(got):
            part = c[2:].split()
            cost = parse.estimate("h") + 1 + sum(parse.estimate(w) + 1 for w in part)
            assert len(got) == 1 or cost <= parse.BUDGET or len(part) == 1
            where = flat[at : at + len(part)]
            assert where == part
            if k + 1 < len(got):
                nxt = got[k + 1][2:].split()
                share = next(s for s in range(len(part), -1, -1) if part[len(part) - s :] == nxt[:s] and sum(parse.estimate(w) + 1 for w in part[len(part) - s :]) <= parse.OVERLAP and s < len(part))
                at += len(part) - share
        assert at + len(got[-1][2:].split()) == len(flat)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    near = graph.n_hop(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert {(r.node, r.hops) for r in near.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.shortest_path(e, "d", "a") == ["d", "c", "b", "a"]
    assert graph.shortest_path(e, "a", "a") == ["a"]
    assert graph.shortest_path(e, "a", "y") is None


LOG = """commit c1
Author: A <a@b>
Date:   2024-01-02 03:04:05 +0000

    message

diff --git a/n.md b/n.md
--- a/n.md
+++ b/n.md
@@ -1,2 +1 @@
-old [[x|alias]] line that is long enough
-- short
-sentiment-hash: 12345678901234567890
-another deleted line that is long
+new [[y#h]] and [[z]]
commit c2
Author: B <b@c>
Date:   2024-01-03 03:04:05 +0000
--- a/m.md
+++ b/m.md
-this is the last deleted line, never flushed
"""


def test_git_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    log = vault.git_log(spark, str(tmp_path / "log.txt"))
    got = [tuple(r) for r in events.link_history(log).orderBy("target").collect()]
    date = "2024-01-02 03:04:05 +0000"
    assert got == [("c1", date, "n.md", "x", "remove"), ("c1", date, "n.md", "y", "add"), ("c1", date, "n.md", "z", "add")]
    gone = [tuple(r) for r in events.deleted_chunks(log).collect()]
    assert gone == [("c1", date, "A <a@b>", "n.md", "old [[x|alias]] line that is long enough\nanother deleted line that is long")]


def test_calls(spark):
    bodies = ['{"end":"2024-01-01T10:00:00Z","durationSeconds":60}', '{"start":"2024-01-01T10:00:00Z","durationSeconds":60,"contact":"","direction":"in"}', "{}", '{"start":"x","end":"2024-01-01T10:00:00Z","durationSeconds":5}', "not json", None, '{"start":"2024-01-01T10:00:00Z","durationSeconds":0}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", vault.call_events(F.col("b")).alias("call"))
    got = events.responses(events.calls(rows)).orderBy("i").collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False, False]
    assert (got[0].end - got[0].start).seconds == 60 and (got[1].end - got[1].start).seconds == 60
    assert got[1].title == "WhatsApp call: Unknown" and got[1].description == "direction: in\ndurationSeconds: 60\nsource: android" and got[1].calendar == "WhatsApp Calls"
    assert json.loads(got[0].response) == {"ok": True, "title": "WhatsApp call: Unknown"}
    assert json.loads(got[2].response)["ok"] is False and "error" in json.loads(got[2].response)


def test_transcripts(spark, tmp_path):
    lines = [{"role": "assistant", "message": {"id": "m"}, "content": [{"type": "text", "text": "a"}, {"type": "thinking", "text": "t"}]}] * 2 + [{"role": "user", "message": {"id": "u"}, "content": [{"type": "text", "text": "b"}]}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [tuple(r) for r in vault.transcripts(spark, str(tmp_path / "s.jsonl")).collect()] == [("m", "a")]


def test_humidity(spark):
    rh = spark.range(1).select(X.relative_humidity_after(F.lit(20.0), F.lit(77.0), F.lit(25.0)).alias("r")).first().r
    assert rh == round(77 * math.exp(17.62 * 20 / 263.12) / math.exp(17.62 * 25 / 268.12), 2)


def test_files_by_md5(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], schemas.FILES)
    cached = files.select("path", F.md5("content").alias("md5")).where("path = 'a'")
    assert [r.path for r in vault.changed_files(files, cached).collect()] == ["b"]
    assert vault.table_or_empty(spark, "/nonexistent/table", schemas.EDGES).count() == 0


def test_evolve(spark):
    old = spark.createDataFrame([("a", 1)], "path string, more int")
    assert schemas.evolve(old, schemas.NOTES).columns == schemas.NOTES.names
    assert schemas.evolve(old, schemas.EDGES, {"source_path"}) is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("## H\ntext")
    store = lifecycle.Store(spark, str(tmp_path / "store"))
    for text in ("## H\nx", "## H\ny"):
        ingest.ingest(ingest.note_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
        (tmp_path / "in" / f"{text[-1]}.md").write_text(text)
    ingest.ingest(ingest.note_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.filename for r in ingest.latest_notes(spark, store).collect()) == ["a.md", "x.md", "y.md"]
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "1.json").write_text('{"end":"2024-01-01T10:00:00Z","durationSeconds":60}\n')
    ingest.call_stream(spark, str(tmp_path / "calls"), str(tmp_path / "cp2"), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().ok


def test_providers():
    assert search.providers(["CPUExecutionProvider", "CUDAExecutionProvider"]) == ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert search.providers([]) == ["CPUExecutionProvider"]


def test_latest_files_and_read_section(spark, tmp_path):
    import os

    for i in range(4):
        (tmp_path / f"{i}.jsonl").write_text("{}")
        os.utime(tmp_path / f"{i}.jsonl", (1000 + i, 1000 + i))
    assert [r.path[-7:] for r in vault.latest_files(spark, str(tmp_path), 2).collect()] == ["3.jsonl", "2.jsonl"]
    rows = spark.createDataFrame([("a.md", "H", 3, 1, "y"), ("a.md", "H", 3, 0, "x"), ("b.md", "H", 1, 0, "z")], "path string, heading string, start_line int, chunk_index int, text string")
    assert [r.text for r in notes.read_section(rows, "a.md", "H").collect()] == ["x", "y"]


def test_products(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0],), (None,), ([0.5, -0.5],), ([],)], "v array<float>")
    got = rows.select(search.dot(F.col("v"), [2.0, 1.0]).alias("d"), search.norm("v").alias("n")).collect()
    assert [r.d for r in got] == [4.0, None, None, 0.5, None]
    assert [r.n for r in got] == pytest.approx([math.sqrt(5), 3.0, None, math.sqrt(0.5), 0.0])
    assert rows.limit(0).select(search.dot(F.col("v"), [1.0])).count() == 0


def test_folding():
    assert X.fold_tokens("Café_ÉTÉ ﬁne x² Ǆ") == ["cafe", "ete", "fine", "x2", "dz"]


def _longest(texts):
    assert 0 < len(texts) <= 5
    return max(texts, key=lambda t: (len(t), t))


def test_rollup(spark):
    """No call gets more than fan_in texts, hot keys and equal texts too; null texts count for nothing."""
    rows = [("hot", "s")] * 300 + [("hot", f"t{i}") for i in range(200)] + [("one", "x"), ("none", None), (None, "y"), (None, "yy")]
    got = sessions.rollup(spark.createDataFrame(rows, "key string, text string"), _longest, fan_in=5).collect()
    assert {r.key: r.text for r in got} == {"hot": "t199", "one": "x", None: "yy"}


def test_sessions(spark):
    turns = spark.createDataFrame([(1, ["a/b.py", "c.py"], "ok"), (2, ["a/b.pyc"], "error"), (3, None, "error")], "turn int, files_touched array<string>, status string")
    assert [r.turn for r in sessions.touching(turns, "%b.py%").collect()] == [1, 2]
    assert [r.turn for r in sessions.provenance(turns, "a/b.py").collect()] == [1]
    assert [r.turn for r in sessions.failed(turns).collect()] == [2, 3]
    names = spark.createDataFrame([("r1", "process_payment"), ("r1", "Pay"), ("r2", "repay"), ("r3", "pay")], "repo string, symbol string")
    assert [(r.repo, r.symbol) for r in sessions.symbols(names, ["r1", "r2"], "pay").collect()] == [("r1", "Pay"), ("r1", "process_payment"), ("r2", "repay")]


def test_long_chain(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)], "src string, dst string")
    assert graph.shortest_path(e, "n0", "n24") == [f"n{i}" for i in range(25)]


def test_windowed_counts(spark, tmp_path):
    from datetime import datetime

    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), k) for m, k in ((1, "a"), (2, "a"), (59, "b"))] + [(datetime(2024, 1, 1, 5), "c")], "at timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, kind string").parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream, "at", "kind").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.hour, r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, "a", 2), (0, "b", 1)]  # the last hour isn't final


def test_logs_are_carried_by_blocks(spark, monkeypatch):
    """Headers and runs reach over blocks, whatever their size, and one log's lines are worked on by several tasks."""
    rng = random.Random(5)
    kinds = ["commit c{}", "Author: A{}", "Date:   2024-01-{}", "--- a/n{}.md", "+++ b/n{}.md", "-a line that is long enough to stay [[t{}]]", "-a line that is long enough to go {}", "-short", "+new [[y{}|z]]", " kept", ""]
    rows = [(f, n, rng.choice(kinds).format(rng.randrange(10, 99))) for f in "ab" for n in range(400)]
    log = spark.createDataFrame(rows, "file string, n long, line string")
    links, gone = [], []
    for f in "ab":
        head, run = dict.fromkeys(("commit", "author", "date", "file", "path")), []
        for _, _, x in (r for r in rows if r[0] == f):
            for key, mark in (("commit", "commit "), ("author", "Author:"), ("date", "Date:"), ("file", "--- a/"), ("file", "+++ b/"), ("path", "--- a/")):
                if x.startswith(mark):
                    head[key] = x[len(mark) :].strip()
            if x[:1] in ("+", "-") and "[[" in x:
                links.append((head["commit"], head["date"], head["file"], x.split("[[")[1].split("]")[0].split("|")[0], "add" if x[0] == "+" else "remove"))
            if x.startswith("-a line"):
                run.append(x[1:])
            elif not x.startswith(("commit ", "Author:", "Date:", "--- a/", "-short")):
                gone += [(head["commit"], head["date"], head["author"], head["path"], "\n".join(run))] if run else []
                run = []
    for block in (2, 5, 16):
        monkeypatch.setattr(events, "BLOCK", block)
        assert sorted(map(tuple, events.link_history(log).collect()), key=repr) == sorted(links, key=repr)
        assert sorted(map(tuple, events.deleted_chunks(log).collect()), key=repr) == sorted(gone, key=repr)
    monkeypatch.setattr(events, "BLOCK", 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = events.link_history(log.where("file = 'a'"))
        assert one.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_query_postings(spark):
    """The postings of a query's terms and the statistics of all documents, as the whole index has them."""
    docs = {"1": "common beta foo bar", "2": "common bar foo cafe", "3": "", "4": "CAFÉ x y common z", "5": None}
    rows = spark.createDataFrame(list(docs.items()), "id string, t string")
    phrases = X.query_phrases("foo_bar common Café")
    index, stats = search.query_postings(rows, "id", F.col("t"), sorted({t for p in phrases for t in p}))
    whole = search.postings(rows, "id", F.col("t"))
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, whole.where(F.col("term").isin("foo", "bar", "common", "cafe")).collect()))
    assert stats.first() == search.statistics(rows, whole).first()
    assert sorted(map(tuple, search.bm25(index, stats, phrases).collect())) == sorted(map(tuple, search.bm25(whole, search.statistics(rows, whole), phrases).collect()))


def test_only_the_parts_asked_for(spark):
    files = spark.createDataFrame([("a.md", bytearray(b"## X\nword [[c]]")), ("b.md", b"---\nenergy: " + b"9" * 5000 + b"\n---\n[[d]]")], schemas.FILES)
    every = {r.path: r for r in notes.parse_files(files).collect()}
    for part in notes.PARTS:
        for r in notes.parse_files(files, [part]).collect():
            assert (r[part], r.error) == (every[r.path][part], every[r.path].error)
            assert all(not r[p] for p in notes.PARTS if p != part)


def test_small_files_are_few_tasks(spark, tmp_path):
    """A batch of many notes is listed and read by few tasks, and the caller's session keeps its settings."""
    (tmp_path / "in").mkdir()
    for k in range(100):
        (tmp_path / "in" / f"{k}.md").write_text(f"## H{k}\ntext")
    stream, sizes = ingest.note_stream(spark, str(tmp_path / "in")), []
    assert all(spark.conf.get(k) != v for k, v in ingest.SMALL_FILES.items())
    query = stream.writeStream.foreachBatch(lambda rows, n: sizes.append((rows.count(), rows.rdd.getNumPartitions()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [n for n, _ in sizes] == [100] and sizes[0][1] <= 4


def test_links_without_a_key_are_spread(spark):
    """A link of no target, or of none beside its source, has null keys, which all met in one task of each join."""
    links = spark.createDataFrame([(f"n{k}.md", t, k) for k in range(200) for t in ("#top", "n1", "no")], "source_path string, raw_target string, start_line int")
    rows = graph.resolve(links, spark.createDataFrame([(f"n{k}.md",) for k in range(200)], "path string"))
    assert {(r.raw_target, r.resolved_target_path) for r in rows.collect()} == {("#top", None), ("n1", "n1.md"), ("no", None)} and rows.count() == 600
    shuffled = rows._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.count("LeftOuter") == 3 and shuffled.count("xxhash64") >= 3
