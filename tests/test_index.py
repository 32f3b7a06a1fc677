"""The index over a small folder of notes: build, search, links, duplicates, reuse of vectors."""

import os

import pytest

from pyspark.sql import functions as F

from loomnote import api, schemas
from loomnote.operators import build, graph, lifecycle, notes, search
from loomnote.sources import vault


def _vault(folder):
    (folder / "folder").mkdir()
    fence = "-" * 3
    lines = [fence, "tags:", "  - test", fence, "", "## Planned", "A distinctivephrase appears here. [[folder/beta]]", "", "## Long", " ".join(["word"] * 1000)]
    (folder / "alpha.md").write_text("\n".join(lines))
    (folder / "folder" / "beta.md").write_text("\n".join(["## Result", "A linked destination.", ""]))
    return str(folder)


def embedder(texts):
    out = []
    for t in texts:
        v = [0.0] * schemas.DIMENSIONS
        for w in t.lower().split():
            v[sum(map(ord, w)) % schemas.DIMENSIONS] += 1.0
        out.append(v)
    return out


def test_build_search_links(spark, tmp_path, capsys):
    root = _vault(tmp_path)
    index = str(tmp_path / ".obsidian" / "index")
    counts = api.build_index(spark, root, index, skip_embeddings=True)
    assert counts == {"notes": 2, "sections": 9, "links": 1, "vectors": 0, "errors": 0, "run_id": 1}
    store = lifecycle.Store(spark, index)
    edge = store.table("edges").collect()
    assert len(edge) == 1 and edge[0].source_path == "alpha.md" and edge[0].raw_target == "folder/beta"
    assert edge[0].resolved_target_path == "folder/beta.md" and edge[0].start_line == 7
    note = store.table("notes").where("path = 'alpha.md'").first()
    assert note.tags == ["test"] and note.category == "general" and note.summary_snippet == "## Planned\n## Long"
    hit = api.search_index(spark, "distinctivephrase", root, index)[0]
    assert (hit["path"], hit["start_line"], hit["lex_rank"], hit["vec_rank"], hit["raw_sim"]) == ("alpha.md", 6, 1, None, None)
    assert "[distinctivephrase]" in hit["snippet"]
    links = api.query_links(spark, "folder/beta", root, index)
    assert links["path"] == "folder/beta.md" and links["inbound"] == [("alpha.md", "folder/beta", 7)] and links["outbound"] == []
    assert api.query_links(spark, "BETA", root, index)["path"] == "folder/beta.md"
    assert api.query_links(spark, "nothing", root, index) is None
    assert api.search_index(spark, "!!", root, index) == []
    stats = api.print_stats(spark, root, index)
    assert (stats["notes"], stats["sections"], stats["text_rows"], stats["title_rows"], stats["edges"], stats["vectors"], stats["status"]) == (2, 9, 9, 2, 1, 0, "metadata-only")
    assert [r["path"] for r in api.check_duplicate(spark, "Beta", root, index)] == ["folder/beta.md", "alpha.md"]  # by title, then by text


def test_vectors_are_reused(spark, tmp_path):
    root = _vault(tmp_path)
    index = str(tmp_path / "index")
    first = api.build_index(spark, root, index, embedder=embedder, embed_round=4)
    assert first["vectors"] == 9
    assert {r.key: r.value for r in lifecycle.Store(spark, index).meta().collect()}["schema_version"] == "2"
    hits = api.search_index(spark, "linked destination", root, index, embedder=embedder)
    assert hits[0]["path"] == "folder/beta.md" and hits[0]["vec_rank"] == 1 and hits[0]["score"] == pytest.approx(2 / 61)
    (tmp_path / "folder/beta.md").write_text("\n".join(["## Result", "Another text."]))
    (tmp_path / "gamma.md").write_text("## Planned\nA distinctivephrase appears here. [[folder/beta]]\n")
    second = api.build_index(spark, root, index, skip_embeddings=True)
    assert second["notes"] == 3 and second["vectors"] == 9 and second["run_id"] == 2  # the changed one has none, the copy has
    rows = {r.id: r.vector is None for r in lifecycle.Store(spark, index).table("sections").collect()}
    assert rows["folder/beta.md::0:0"] and not rows["gamma.md::0:0"]
    (tmp_path / "alpha.md").unlink()
    assert api.build_index(spark, root, index, embedder=embedder)["vectors"] == 2
    assert api.semantic_search(spark, "another text", embedder, index, 1)[0][1] == "folder/beta.md"


def test_rounds_are_no_passes(spark, tmp_path):
    """Rounds were a scan of all sections each; now a build's jobs don't grow with their number, and rounds are still kept."""
    root, jobs = _vault(tmp_path), []
    for size in (1000, 1):
        spark.sparkContext.setJobGroup(f"round {size}", "")
        assert api.build_index(spark, root, str(tmp_path / f"index {size}"), embedder=embedder, embed_round=size)["vectors"] == 9
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"round {size}")))
    assert jobs[1] <= jobs[0] + 2
    assert lifecycle.Store(spark, str(tmp_path / "index 1")).log("vectors", api.VECTORS).count() == 9

    def broken(texts):
        if any("linked" in t for t in texts):
            raise ValueError("broken off")
        return embedder(texts)

    (tmp_path / "alpha.md").write_text("\n".join(["word"] * 90_000))  # some batches come before the one that fails
    with pytest.raises(Exception, match="broken off"):
        api.build_index(spark, root, str(tmp_path / "index 0"), embedder=broken, embed_round=100)
    store = lifecycle.Store(spark, str(tmp_path / "index 0"))
    assert store.current() is None and store.log("vectors", api.VECTORS).count() >= 128


def test_index_is_written_without_shuffles(spark, tmp_path):
    """All postings were shuffled and sorted by their terms, and all sections by their paths; a build took its time for it."""
    for k in range(300):
        (tmp_path / f"n{k % 7} {k}.md").write_text(f"## Part\n{'word ' * (k % 5)}Ünlike {k} 漢字 a_b [[n1 1]]\n## Other\nx{k}\n")
    store = lifecycle.Store(spark, str(tmp_path / "index"))
    assert api.build_index(spark, str(tmp_path), store.folder, embedder=embedder)["sections"] == 600
    found = [f.relative_to(tmp_path / "index").as_posix().split("/")[2] for f in (tmp_path / "index" / "runs").rglob("*.parquet")]
    assert "joined" not in found and found.count("sections_postings") == found.count("sections") > 2
    sections, kept, n = store.table("sections"), store.table("sections_postings"), 0
    assert sections.where("vector is null").count() == 0
    for part in sorted((tmp_path / "index" / "runs").rglob("sections/part*")):  # paths of one range each, in order
        paths = [r.path for r in spark.read.parquet(str(part)).collect()]
        assert paths == sorted(paths)
        n += len(paths)
    assert n == 600
    want = search.postings(sections, "id", F.col("text"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    stats = search.statistics(sections, want).first()
    assert store.table("sections_stats").first() == stats and stats.docs == 600
    part = next((tmp_path / "index" / "runs").rglob("sections_postings/part*"))
    terms = [r.term for r in spark.read.parquet(str(part)).collect()]
    assert terms == sorted(terms)  # few notes: one group a file


def test_no_index(spark, tmp_path):
    assert api.search_index(spark, "x", str(tmp_path), str(tmp_path / "none")) == []
    assert api.check_duplicate(spark, "x", str(tmp_path), str(tmp_path / "none")) == []
    assert api.query_links(spark, "x", str(tmp_path), str(tmp_path / "none")) is None
    assert api.print_stats(spark, str(tmp_path), str(tmp_path / "none")) is None


def test_empty_vault(spark, tmp_path):
    counts = api.build_index(spark, str(tmp_path), str(tmp_path / "index"))
    assert counts == {"notes": 0, "sections": 0, "links": 0, "vectors": 0, "errors": 0, "run_id": 1}
    assert api.search_index(spark, "word", str(tmp_path), str(tmp_path / "index")) == []


def test_one_build_writes_at_a_time(spark, tmp_path):
    store = lifecycle.Store(spark, str(tmp_path / "index"))
    with store.lock():
        with pytest.raises(TimeoutError):
            with store.lock(wait=0.2):
                pass
    with store.lock(wait=0.2):
        pass
    lock = tmp_path / "index" / "LOCK"
    lock.write_text("")
    store.ABANDONED = 0.5  # what a build left behind is taken over
    with store.lock(wait=5):
        assert lock.exists()
    store.BEAT, store.ABANDONED = 0.1, 1.0  # but not what is renewed
    with store.lock():
        with pytest.raises(TimeoutError):
            with store.lock(wait=2.5):
                pass
    assert not lock.exists()


def test_vectors_are_compacted_and_meta_upserted(spark, tmp_path):
    store = lifecycle.Store(spark, str(tmp_path / "index"))
    keys = ["sha256", "embedding_model", "chunking_version"]
    for k in range(4):
        store.append("vectors", spark.createDataFrame([("a", "m", "c", [1.0]), (f"b{k}", "m", "c", [2.0])], api.VECTORS).coalesce(1))
    store.compact("vectors", keys, files=100)
    assert store.log("vectors", api.VECTORS).count() == 8
    store.compact("vectors", keys, files=3)
    assert sorted(r.sha256 for r in store.log("vectors", api.VECTORS).collect()) == ["a", "b0", "b1", "b2", "b3"]
    (tmp_path / "index" / "vectors").rename(tmp_path / "index" / "vectors.old")  # broken off between the renames
    store.compact("vectors", keys)
    assert store.log("vectors", api.VECTORS).count() == 5
    store.put({"a": "1", "b": "2"})
    store.put({"b": "3"})
    assert {r.key: r.value for r in store.meta().collect()} == {"a": "1", "b": "3"}


def test_history(spark, tmp_path):
    from tests.test_operators import LOG

    (tmp_path / "log.txt").write_text(LOG)
    index = str(tmp_path / "index")
    assert api.index_history(spark, str(tmp_path / "log.txt"), index, embedder) == 1
    assert api.index_history(spark, str(tmp_path / "log.txt"), index, embedder, authors=["Nobody"]) == 0
    assert lifecycle.Store(spark, index).log("link_events", schemas.LINK_EVENTS).count() == 6  # two runs
    hit = api.search_history(spark, "another deleted line that is long", embedder, index)[0]
    assert hit["path"] == "n.md" and hit["sha"] == "c1" and hit["raw_sim"] > 0.5
    assert api.search_history(spark, "deleted", embedder, index, since="2024-02-01") == []


def _onnx(table) -> bytes:
    """A model file whose output is the row of ``table`` for each token."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def number(field, x):
        return varint(field << 3) + varint(x)

    def part(field, *content):
        b = b"".join(c.encode() if isinstance(c, str) else c for c in content)
        return varint(field << 3 | 2) + varint(len(b)) + b

    def value(name, kind, *dims):
        shape = part(2, *(part(1, part(2, d)) if isinstance(d, str) else part(1, number(1, d)) for d in dims))
        return part(1, name) + part(2, part(1, number(1, kind), shape))

    weights = part(5, *(number(1, d) for d in table.shape), number(2, 1), part(8, "table"), part(9, table.tobytes()))
    node = part(1, part(1, "table"), part(1, "input_ids"), part(2, "state"), part(4, "Gather"))
    inputs = [part(11, value(n, 7, "b", "s")) for n in ("input_ids", "attention_mask")]
    graph = part(7, node, part(2, "g"), weights, *inputs, part(12, value("state", 1, "b", "s", table.shape[1])))
    return number(1, 8) + graph + part(8, number(2, 13))


def test_onnx_embedder(spark, tmp_path, capsys):
    np, tokenizers = pytest.importorskip("numpy"), pytest.importorskip("tokenizers")
    pytest.importorskip("onnxruntime")
    words = ["[UNK]", "linked", "planned", "word", "result"]
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = tokenizers.normalizers.Lowercase(), tokenizers.pre_tokenizers.Whitespace()
    (tmp_path / "model").mkdir()
    t.save(str(tmp_path / "model" / "tokenizer.json"))
    table = np.random.default_rng(1).normal(size=(len(words), schemas.DIMENSIONS)).astype(np.float32)
    (tmp_path / "model" / "model.onnx").write_bytes(_onnx(table))
    (tmp_path / "vault").mkdir()
    model, root, index = api.OnnxEmbedder(str(tmp_path / "model")), _vault(tmp_path / "vault"), str(tmp_path / "index")
    assert np.allclose(model(["linked word", "what"]), table[[1, 0]])
    assert api.build_index(spark, root, index, embedder=model)["vectors"] == 9
    assert api.semantic_search(spark, "result", model, index, 1)[0][:2] == (pytest.approx(1.0, abs=1e-5), "folder/beta.md")
    assert api.main(["--vault", root, "--db", index, "--search", "result", "--model", str(tmp_path / "model")]) == 0
    assert "vec 1" in capsys.readouterr().out


def test_ranges_that_did_not_change_are_taken_over(spark, tmp_path, capsys):
    """Each build parsed and tokenized every note again; now it reads and hashes all, and works on the ranges that changed."""
    root = tmp_path / "notes"
    root.mkdir()
    for k in range(400):
        (root / f"n{k:03}.md").write_text(f"## Part\nword Ünlike {k} [[n001]]\n## Other\nx{k}\n")
    (root / "n010.md").write_bytes(b"---\nenergy: " + b"9" * 5000 + b"\n---\ntext")
    store = lifecycle.Store(spark, str(tmp_path / "index"))

    def carried(**how) -> int:
        capsys.readouterr()
        api.build_index(spark, str(root), store.folder, **how)
        return int(capsys.readouterr().out.split(" ranges of notes")[0].rsplit(" ", 1)[1])

    def like_new(**how) -> None:
        new = lifecycle.Store(spark, str(tmp_path / f"new {len(list(tmp_path.iterdir()))}"))
        api.build_index(spark, str(root), new.folder, **how)
        for name in ("sections", "sections_postings", "sections_stats", "titles_postings", "notes", "edges", "parsed"):
            assert sorted(map(repr, store.table(name).collect())) == sorted(map(repr, new.table(name).collect())), name
        runs = [s.log("index_runs", schemas.RUNS).orderBy(F.col("id").desc()).drop("id", "started_at", "completed_at").first() for s in (store, new)]
        assert runs[0] == runs[1] and runs[0].error_count == 1

    assert carried() == 0 and carried(skip_embeddings=True) == 4
    like_new()
    times = (root / "n399.md").stat()
    (root / "n399.md").write_text("## Part\nword Ünlike 398 [[n001]]\n## Other\nx398\n")  # as long and as old as before
    os.utime(root / "n399.md", ns=(times.st_atime_ns, times.st_mtime_ns))
    (root / "n000.md").unlink()
    (root / "n150a.md").write_text("## New\nnote [[n399]]")
    assert carried() == 1
    like_new()
    assert carried(embedder=embedder) == 4
    like_new(embedder=embedder)
    assert store.table("sections").where("vector is null").count() == 0
    assert carried(embedder=embedder) == 0  # vectors are matched by id and hash
    like_new(embedder=embedder)


def test_names_are_dealt_in_ranges_that_stay():
    names = [f"{k:05}" for k in range(10_000)]
    first = build.deal(names, 2)
    assert [x for part, _ in first for x in part] == names and len(first) == 5
    starts = [part[0] for part, _ in first]
    more = sorted([*names, "-", "04000a", "~"])
    again = build.deal(more, 2, starts)
    assert [x for part, _ in again for x in part] == more and [k for _, k in again] == [0, 1, 2, 3, 4] and again[1][0] == first[1][0]
    grown = build.deal(sorted([*names, *(f"00001{k:05}" for k in range(5000))]), 2, starts)
    assert max(len(part) for part, _ in grown) <= 4000 and [k for _, k in grown][-4:] == [1, 2, 3, 4]
    assert [k for _, k in build.deal(names[4000:], 2, starts)] == [2, 3, 4]  # ranges without notes go
    assert {k for _, k in build.deal(names, 40, starts)} == {None} and build.deal([], 2, starts) == build.deal([], 2) == []


def test_parts_taken_over_take_no_room(tmp_path):
    for name in "ab":
        (tmp_path / name).mkdir()
    old, new = tmp_path / "a/part-000001.parquet", tmp_path / "b/part-000003.parquet"
    old.write_bytes(b"rows")
    vault.copy_part(str(tmp_path / "a"), 1, f"file://{tmp_path}/b", 3)
    assert os.path.samefile(old, new)
    old.unlink()  # an old snapshot goes
    assert new.read_bytes() == b"rows" and [f.name for f in (tmp_path / "b").iterdir()] == [new.name]


def test_edges_are_those_of_resolve(spark, tmp_path):
    """Every link was shuffled for each of its three keys, all links of a hot target to one task; now a range looks for a key once."""
    ends = ["", " ", "\x85", " \x85", " ", "\n", "/", "//", "/\x85", "\xa0", "\x1c", ".md", ".MD", "|x", "#y", "/ "]
    middles = ["a", "f/a", "./f/a", "/f/a", "f//a", "././a", "f/./a", "..a", ".", "/", "./", "", " a", "\x85a", " a", "ẞ", "ΑΣ", "f\\a", "a.b", "g/ss", "\n/a", "İ", "nowhere"]
    names = ["a.md", "A.md", "f/a.md", "f/b.md", "g/ß.md", "g/b.md", ".md", "f/..a.md", "a.b.md", "ας.md", "x\x85.md", "h\x85i/a.md", "h\x85i/c.md", "f/x.y.md", "i̇.md", ".hid.md", "\x85.md"]
    links = "\n".join(f"[[{m}{e}]] [[{m}{e}]]" for m in middles for e in ends)
    vault.write_files(str(tmp_path), [(n, links.encode()) for n in names] + [(f"n{k}.md", b"[[nowhere]]\n[[nowhere]]\n[[#top]]") for k in range(400)])
    (tmp_path / "f" / "broken.md").write_bytes(b"---\nenergy: " + b"9" * 5000 + b"\n---\n[[a]]")
    store = lifecycle.Store(spark, str(tmp_path / "index"))
    api.build_index(spark, str(tmp_path), store.folder)
    want = graph.distinct_edges(graph.resolve(notes.raw_links(store.table("parsed")), store.table("notes")))
    got = store.table("edges")
    assert got.count() > 10_000 / 2 and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    ranges = len(list((tmp_path / "index" / "runs").rglob("parsed/part*")))
    assert store.table("keys").where("key = 'pnowhere'").count() == ranges > 2
    api.build_index(spark, str(tmp_path), store.folder)  # taken over
    assert sorted(map(repr, store.table("edges").collect())) == sorted(map(repr, want.collect()))


def test_local_notes_are_listed_without_asking_for_each(tmp_path, monkeypatch):
    """Listing asked for every file's size and time, one after the other on the driver; a local folder's names say what they are."""
    for name in ("b.md", "a/.hidden/c.md", "a/x.txt", "a/UP.MD", "a-b/d.md", ".obsidian/no.md", "a/node_modules/no.md", "md/e.md", "dir.md/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "link.md").symlink_to(tmp_path / "b.md")
    (tmp_path / "linked").symlink_to(tmp_path / "a-b")
    (tmp_path / "gone.md").symlink_to(tmp_path / "nothing")
    want = ["a/.hidden/c.md", "a-b/d.md", "b.md", "dir.md/f.md", "link.md", "linked/d.md", "md/e.md"]
    with monkeypatch.context() as m:
        m.setattr(vault, "_local_entries", lambda folder: vault._entries(vault.pafs.LocalFileSystem(), folder))
        assert vault.note_paths(tmp_path) == want
    monkeypatch.setattr(vault, "_entries", None)
    assert vault.note_paths(tmp_path) == vault.note_paths(f"file://{tmp_path}/") == want and vault.note_paths(tmp_path / "none") == []


def test_edges_of_ranges_that_find_the_same_are_taken_over(spark, tmp_path):
    """Each build made all edges anew; now those of a range are taken over where its notes and what its links find are as before."""
    vault.write_files(str(tmp_path), [(f"n{k:03}.md", f"[[n{k + 1:03}]] [[new]]".encode() if k < 200 else b"[[n001]]") for k in range(400)])
    store = lifecycle.Store(spark, str(tmp_path / "index"))

    def links_of_parts() -> list[int]:
        api.build_index(spark, str(tmp_path), store.folder)
        want = graph.distinct_edges(graph.resolve(notes.raw_links(store.table("parsed")), store.table("notes")))
        assert sorted(map(repr, store.table("edges").collect())) == sorted(map(repr, want.collect()))
        return [p.stat().st_nlink for p in sorted((tmp_path / "index" / "runs" / store.current()["run"] / "edges").glob("part*"))]

    assert links_of_parts() == [1] * 4 and links_of_parts() == [2] * 4
    (tmp_path / "n399a.md").write_text("x")  # no link finds it
    again = links_of_parts()
    assert again[-1] == 1 and min(again[:3]) > 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "new.md").write_text("x")  # in the first range by its path; half of all notes name it
    last = links_of_parts()
    assert last[:2] == [1, 1] and last[2] > 1
