"""License scans, archives and host reputation."""

import datetime
import io
import os
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomnote.llm import archive, hosts, licenses, queries

D = "/root/testdata/sf0.001"


def plain_lis(places):
    best = [1] * len(places)
    for i, x in enumerate(places):
        best[i] = 1 + max((best[j] for j in range(i) if places[j] < x), default=0)
    return max(best, default=0)


def test_alignment():
    rng = random.Random(6)
    for _ in range(200):
        p = rng.sample(range(40), rng.randrange(1, 30))
        lis = licenses._lis(p)
        assert len(lis) == plain_lis(p) and all(a < b and p[a] < p[b] for a, b in zip(lis, lis[1:]))
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        m = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert licenses.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def test_triggers_can_not_be_missed():
    for name, text in licenses.TEMPLATES:
        t = licenses.Template(name, text)
        assert sum(w in t.triggers for w in t.words) > len(t.words) * (1 - licenses.COVERAGE) - 1e-9


def test_the_trigger_pattern_is_that_of_the_words():
    regex = pytest.importorskip("regex")
    rng = random.Random(3)
    library = licenses.Library(licenses.TEMPLATES)
    triggers = sorted(set().union(*(t.triggers for t in library.templates)))
    pattern = regex.compile(licenses.trigger_pattern(library.templates))
    assert all(pattern.search(f"x {w} y") and pattern.search(w) for w in triggers)
    for _ in range(3000):
        w = rng.choice(triggers)
        k = rng.randrange(len(w) + 1)
        w = rng.choice((w[:k], w + rng.choice("aes2"), w[k:], w[:k] + rng.choice("xy") + w[k:], w + "-" + w))
        assert bool(pattern.search(w)) == any(p in triggers for p in regex.findall(r"[\p{L}\p{N}.]+", w)) or "." in w


def test_licenses(spark):
    rng = random.Random(2)
    mit = licenses._MIT.split()
    noisy = " ".join(w for w in mit if rng.random() > 0.08)
    notice = "Released under the MIT License."
    texts = {
        1: "prose " * 300 + noisy + " more" * 300, 2: notice, 3: f"{notice} {notice}\n{notice}", 4: "the license of software is under a public view " * 200, 5: None, 6: "", 7: "Licensed under the Apache License, Version 2.0.",
        8: "This work is licensed under the GNU General Public License, version 3.", 9: "licensed, he said. " + "word " * 50 + "under the apache", 10: "LICENSED UNDER CC BY-NC 4.0!", 11: licenses._APACHE, 12: "word " * 200_000 + notice,
        13: "MIT License the under released", 14: "plain words",
    }
    docs = spark.createDataFrame([*((i, t, "x") for i, t in texts.items()), (2, texts[2], "x"), (None, texts[2], "x")], "doc_id long, text string, license string")
    rows = licenses.find_licenses(docs).collect()
    got = sorted(((r.doc_id or 0, r.license) for r in rows))
    assert got == [(0, "MIT"), (1, "MIT"), (2, "MIT"), (2, "MIT"), (3, "MIT"), (3, "MIT"), (3, "MIT"), (7, "Apache-2.0"), (8, "GPL-3.0"), (10, "CC-BY-NC-4.0"), (11, "Apache-2.0"), (12, "MIT")]
    one = next(r for r in rows if r.doc_id == 1)
    assert one.template_words == len(licenses.words_of(licenses._MIT)) and one.first_word == 300 and one.coverage > 0.85
    assert next(r for r in rows if r.doc_id == 12).first_word == 200_000
    assert licenses.find_licenses(docs.limit(0)).count() == 0


NOTICES = {
    "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"], "licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"], "Licensed under CC BY 1.0": [], "This work is not licensed under CC BY 4.0": [], "Never released under the MIT License": [],
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": [], licenses._gnu("Lesser", "3"): ["LGPL-3.0"], licenses._gnu("Affero", "3"): ["AGPL-3.0"], licenses._gnu("", "2", old=True): ["GPL-2.0"], licenses._gnu("", "3"): ["GPL-3.0"],
    licenses._BSD3: ["BSD-3-Clause"], licenses._BSD: ["BSD-2-Clause"], licenses._MIT: ["MIT"], licenses._MIT0: ["MIT-0"], "licensed under the Apache License, Version 2.0; released under the MIT License": ["Apache-2.0", "MIT"], "Licensed under the Apache License, version 3.0": [],
}


@pytest.mark.parametrize("text", [*NOTICES])
def test_licenses_that_are_alike(text):
    library = licenses.Library(licenses.TEMPLATES)
    assert [h[0] for h in library.scan(licenses.words_of(text))] == NOTICES[text]


def test_scan_is_that_of_every_window():
    """Alignment at every word of a template, without count filter or skips, gives the same hits; dense texts too."""
    rng, library = random.Random(5), licenses.Library(licenses.TEMPLATES)
    seen = 0
    for n in range(60):
        words = []
        for _ in range(rng.randrange(1, 8)):
            t = rng.choice(library.templates)
            noise = rng.choice((0.0, 0.05, 0.15))
            words += [rng.choice(t.words) if rng.random() < noise / 2 else w for w in t.words if rng.random() >= noise]
            words += [rng.choice(("prose", "the", "of", "license", "under", "software")) for _ in range(rng.randrange(0, 30) if n % 2 else 0)]
        plain = {h for t in library.templates for a, w in enumerate(words) if w in t.count and (h := t.hit(words, a))}
        got = library.scan(words)
        assert got == licenses.best(plain)
        seen += len(got)
    assert seen > 100


def test_best_is_the_plain_choice():
    rng = random.Random(7)
    for _ in range(100):
        hits = {(rng.choice("ab"), a := rng.randrange(60), a + rng.randrange(1, 9), rng.randrange(1, 6), 6) for _ in range(rng.randrange(40))}
        out = []
        for h in sorted(hits, key=lambda h: (-h[3], -h[3] / h[4], h[2] - h[1], h[0], h[1])):
            if all(h[2] <= o[1] or h[1] >= o[2] for o in out):
                out.append(h)
        assert licenses.best(hits) == sorted(out, key=lambda h: h[1])


def test_many_notices_take_linear_time():
    import time

    library, took = licenses.Library(licenses.TEMPLATES), []
    for n in (2000, 8000):
        began = time.thread_time()
        assert len(library.scan(licenses.words_of("Released under the MIT License. " * n))) == n
        took.append(time.thread_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def zipped(members, method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, data in members.items():
            z.writestr(n, data)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("split", [100, 10_000, 1 << 26])
def test_archives_of_others(spark, tmp_path, method, split):
    rng = random.Random(1)
    members = {f"m{i}": rng.randbytes(rng.choice((0, 1, 300, 5000))) for i in range(60)}
    (tmp_path / "a.zip").write_bytes(zipped(members, method))
    (tmp_path / "b.zip").write_bytes(zipped({}, method))
    rows = archive.read_archives(spark, str(tmp_path), split=split, batch=700).collect()
    assert {r.member: bytes(r.payload) for r in rows} == members and len(rows) == 60 and all(r.error is None for r in rows)


def test_broken_members_stand_alone(spark, tmp_path):
    members = {f"m{i}": bytes([i]) * 1000 for i in range(5)}
    raw = bytearray(zipped(members, zipfile.ZIP_STORED))
    at = raw.find(bytes([2]) * 1000)
    raw[at + 10] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    (tmp_path / "cut.zip").write_bytes(bytes(raw[:500]))
    rows = archive.read_archives(spark, str(tmp_path), retries=1).collect()
    by = {r.member: r for r in rows}
    assert by["m2"].payload is None and "CRC" in by["m2"].error
    assert all(bytes(by[m].payload) == members[m] for m in members if m != "m2")
    assert by[None].error and by[None].archive.endswith("cut.zip") and len(rows) == 6


def test_a_member_that_unpacks_too_far_is_an_error():
    """What the directory says is the limit, whatever the data would unpack to."""
    raw = zipped({"bomb": b"0" * 50_000_000}, zipfile.ZIP_DEFLATED)
    m = archive.directory(io.BytesIO(raw), len(raw))[0]
    assert len(archive.payload(io.BytesIO(raw), m)) == 50_000_000
    m.size = 10
    with pytest.raises(ValueError, match="length"):
        archive.payload(io.BytesIO(raw), m)
    m.size = 1 << 31
    with pytest.raises(ValueError, match="too long"):
        archive.payload(io.BytesIO(raw), m)


def test_a_member_is_retried_by_its_offset(monkeypatch):
    raw = zipped({"a": b"1" * 100, "b": b"2" * 100}, zipfile.ZIP_STORED)
    calls = []
    real = archive.payload

    def flaky(f, m):
        calls.append(m.name)
        if calls.count("b") == 1 and m.name == "b":
            raise OSError("lost")
        return real(f, m)

    class FS:
        def open_input_file(self, path):
            return io.BytesIO(raw)

    monkeypatch.setattr(archive, "payload", flaky)
    monkeypatch.setattr(archive, "_open", lambda uri: (FS(), uri))
    reader = archive.MemberReader({"path": "x"})
    got = [m for b in reader.read(archive.ByteRange("x", 0, 1 << 30, len(raw))) for m in b.to_pylist()]
    assert [m["payload"] for m in got] == [b"1" * 100, b"2" * 100] and calls == ["a", "b", "b"] and all(m["error"] is None for m in got)


def test_round_trip_of_columns(spark, tmp_path):
    big = "x" * 3_000_000
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, "b", 9), (2, None, 9), (3, "", 9), (4, big, 9), (5, "é", 9)], "page_id long, html string, member int").repartition(3)
    folder = f"file://{tmp_path}/z"
    assert archive.write_archives(docs, folder, "page_id", "html") == 7
    rows = archive.media_columns(archive.read_archives(spark, folder, split=1000), "page_id")
    want = docs.select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), F.sha2("html", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    ids = ["", None, "a/b", "a/b/", "%00", "x\0y", "100%", "\\z", "!", "?", "é\n"]
    odd = spark.createDataFrame([(i, "p", "q") for i in ids], "page_id string, html string, member string").repartition(2)
    archive.write_archives(odd, f"file://{tmp_path}/odd", "page_id", "html")
    assert Counter(r.page_id for r in archive.media_columns(archive.read_archives(spark, f"file://{tmp_path}/odd"), "page_id", "string").collect()) == Counter(ids)
    with pytest.raises(ValueError):
        archive.member_name("x" * 70_000, 0, False)
    assert archive.write_archives(docs.limit(0), f"file://{tmp_path}/none", "page_id", "html") == 0
    assert archive.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def norm(v):
    return round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def test_reputation_against_sql(spark, tmp_path, monkeypatch):
    import duckdb

    rng = random.Random(3)
    names = {"good.example.com": 0.95, "a.bad.example.net": 0.05, "b.bad.example.net": 0.1, "x.co.uk": 0.6, "www.x.co.uk": 0.5, "co.uk": 0.9, "localhost": 0.5, "10.0.0.1": 0.2, "[::1]": 0.9, "a.github.io": 0.1, "b.github.io": 0.9, "a.b.ck": 0.5, "www.ck": 0.6, "x.www.ck": 0.6, "c.b.ck": 0.4, "deep.a.b.c.ck": 0.5, "new.bad.example.net": None}
    pages, labels = [], []
    for i in range(600):
        host = rng.choice([*names])
        pages.append((i, rng.choice(("http://", "https://", "HTTP://u:p@")) + host.upper() + rng.choice(("", ":80", "/a?b=/c", "#x", "./q")), "h"))
        if names[host] is not None and rng.random() < 0.7:
            labels.append((i, int(rng.random() < names[host]), int(rng.random() < 0.05)))
    pages += [(9000, None, "h"), (9001, "", "h"), (9002, "no url", "h"), (None, "http://good.example.com", "h"), (1, "http://good.example.com/again", "h")]
    labels += [(1, 0, 0), (2, None, 0), (None, 1, 0), (77_777, 1, 0)]
    p = spark.createDataFrame(pages, "page_id long, url string, host string")
    q = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("pages", p), ("labels", q)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    (tmp_path / "rules").write_text("// a comment\nuk\nco.uk\ngithub.io // private\n*.ck\n!www.ck\n\n公司.cn\n")
    rules = hosts.read_rules(str(tmp_path / "rules"))
    assert rules == hosts.Rules(frozenset(["co.uk", "github.io", "公司.cn", "xn--55qx5d.cn"]), frozenset(["ck"]), frozenset(["www.ck"]))
    rel = con.sql(hosts.sql(rules))
    cols = sorted(rel.columns)
    got = hosts.reputation(p, q, rules)
    assert sorted(got.columns) == cols
    want = sorted(repr(tuple(norm(r[rel.columns.index(c)]) for c in cols)) for r in rel.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in cols)) for r in got.collect()) == want
    by = {r.host: r for r in got.collect()}
    assert by["good.example.com"].kept and not by["a.bad.example.net"].kept and by["new.bad.example.net"].domain == "example.net"
    assert by["www.x.co.uk"].domain == "x.co.uk" and by["www.x.co.uk"].suffix == by["co.uk"].domain == "co.uk" and by["localhost"].suffix == "localhost"
    parts = {h: (r.domain, r.suffix) for h, r in by.items()}
    assert parts["10.0.0.1"] == ("10.0.0.1",) * 2 and parts["[::1]"] == ("[::1]",) * 2 and parts["a.github.io"] == ("a.github.io", "github.io")
    assert (parts["a.b.ck"], parts["c.b.ck"], parts["deep.a.b.c.ck"]) == (("a.b.ck", "b.ck"), ("c.b.ck", "b.ck"), ("b.c.ck", "c.ck")) and parts["www.ck"] == parts["x.www.ck"] == ("www.ck", "ck")
    monkeypatch.setattr(hosts, "HOT", 3)
    assert sorted(map(tuple, hosts.reputation(p, q, rules).collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    kept = hosts.filter_urls(p, q, rules)
    assert kept.columns == p.columns and kept.count() == got.where("kept").count()
    none = hosts.reputation(p, q.limit(0)).collect()
    assert all(r.kept and r.rate == 0.5 for r in none) and len(none) == len(pages)
    assert hosts.reputation(p.limit(0), q).count() == 0


@pytest.mark.skipif(not os.path.isdir(D), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    rel, df = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect()) == sorted(repr(tuple(norm(r[rel.columns.index(c)]) for c in cols)) for r in rel.fetchall())
