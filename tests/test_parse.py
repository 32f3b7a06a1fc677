"""The rules for a note's text."""

import re
import unicodedata

import pytest

from loomnote.functions import parse
from loomnote.functions import text as X
from loomnote.operators import graph
from loomnote.sources import vault


def fm(inside, body="x"):
    return parse.front(f"---\n{inside}\n---\n{body}")


def test_frontmatter():
    assert parse.front("plain").line == 1 and parse.front("plain").body == "plain"
    f = fm("tags:\n  - test", "\n## A")
    assert (f.tags, f.body, f.line) == (["test"], "## A", 6)
    assert parse.front("---\n---\ntext").body == "---\n---\ntext"
    assert parse.front("---\n---\na\n---\nb").body == "b"
    assert parse.front("---\n\n---\nb").body == "b"
    assert parse.front("﻿---\na: 1\n---\nb").line == 1
    assert parse.front("---\na: 1\n---").body == ""
    assert parse.front("---\na\n---\n  b").body == "  b"
    assert parse.front("---\na\n--- b\nc").line == 1
    assert parse.front(parse.text_of(b"---\r\nenergy: 4\r\n---\r\nb\xff")).body == "b"


@pytest.mark.parametrize("inside, energy, sentiment", [("energy: -3", None, None), ("energy: 5.5", 5, None), ("sentiment: [5]", None, None), ("sentiment:\n- 7\n- 4", None, 5.5), ("sentiment:\n- 7.5\n- 1", None, 7.0), ("sentiment:\n- -2", None, None)])
def test_numbers(inside, energy, sentiment):
    f = fm(inside)
    assert (f.energy, f.sentiment) == (energy, sentiment)


def test_lists():
    assert fm("tags:\n- - c-\n- 'q'").tags == ["c", "'q'"]
    assert fm("tags: [a]").tags == []
    assert len(fm("tags:\n" + "\n".join(f"- t{i}" for i in range(2000))).tags) == 2000
    assert fm("sentiment-label:\n  - glad\n  - so so").labels == ["glad", "so so"]


def test_sections():
    assert parse.sections("s", "  \n", 1) == []
    assert parse.sections("s", "text", 4) == [("s", 4, "text")]
    assert parse.sections("s", "lead\n## A\nx\n```\n## B\n```\n## \ny\n## C", 2) == [("s", 2, "lead"), ("A", 3, "x\n```"), ("B", 6, "```"), ("s", 8, "y"), ("C", 10, "C")]


def test_chunks():
    assert parse.estimate("foo_bar ab abcde !") == 1 + 1 + 2 + 1
    one = parse.chunk_texts("h", "a " + "x" * 2000)
    assert len(one) == 2 and one[1] == "h\n" + "x" * 2000
    costs = [parse.estimate("word") + 1] * 1000
    assert parse.windows(costs, parse.estimate("Long") + 1) == [(0, 179), (159, 338), (318, 497), (477, 656), (636, 815), (795, 974), (954, 1000)]
    assert parse.chunk_texts(" ", "a  b") == ["Untitled\na b"]


def test_key_lines_and_links():
    assert parse.key_lines("# a\n x\n- [ ] t\n#tag\n" + "- " + "y" * 300) == "# a\n- [ ] t\n#tag\n- " + "y" * 198 + "..."
    assert parse.links("[[a]] [[b|c]]\n[[ ]]\n```\n[[d\ne]]") == [("a", 1), ("b|c", 1), ("d\ne", 4)]


def test_paths_and_keys(tmp_path):
    for p in ("_x.md", "__init_subclass__.md", ".z.md", ".foo/y.md", ".obsidian/no.md", "a/b.MD", "a-b.md", "a/c.md"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert vault.note_paths(tmp_path) == [".foo/y.md", ".z.md", "__init_subclass__.md", "_x.md", "a/c.md", "a-b.md"]
    assert vault.find_root(tmp_path / "a") == tmp_path
    assert X.fold_key(" /Straße.MD ") == X.fold_key("STRASSE") == "strasse"


def test_columns(spark):
    rows = spark.createDataFrame([("day 1.md",), ("a/review x.md",), ("work/p/x.md",), ("work/x.md",), ("x.y.md",), (".z",)], "p string")
    got = rows.select(X.category(rows.p).alias("c"), X.stem(rows.p).alias("s")).collect()
    assert [r.c for r in got] == ["daily", "review", "work/p", "work", "general", "general"]
    assert [r.s for r in got] == ["day 1", "review x", "x", "x", "x.y", ".z"]
    text = spark.createDataFrame([("foo_bar ab abcde !",), ("",), (None,), ("é wörter",)], "t string")
    assert [r.e for r in text.select(X.token_estimate(text.t).alias("e")).collect()] == [5, 0, 0, parse.estimate("é wörter")]


def test_resolution(spark):
    notes = spark.createDataFrame([(p,) for p in ("a.md", "sub/a2.md", "sub/x.md", "o/x.md", "Straße.md", "sub/deep/k.md", "q/uniq.v1.md")], "path string")
    cases = {
        ("a.md", "A|alias"): "a.md", ("a.md", "A.md"): "a.md", ("a.md", "x"): None, ("sub/a2.md", "deep/k"): "sub/deep/k.md", ("a.md", "#h"): None, ("a.md", "a#h"): "a.md",
        ("a.md", "STRASSE"): "Straße.md", ("o/x.md", "a2"): "sub/a2.md", ("a.md", "sub\\x"): "sub/x.md", ("a.md", "a\\|b"): "a.md", ("sub/a2.md", "../a"): "a.md", ("a.md", "none"): None, ("a.md", "k.md"): None,
    }
    links = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(cases)], "source_path string, raw_target string, start_line int")
    got = {(r.source_path, r.raw_target): r.resolved_target_path for r in graph.resolve(links, notes).collect()}
    assert got == cases


def test_costs_and_folding_of_whole_texts():
    """Costs of a text's words come from its characters at once, and folding from a table of characters: the same as word by word."""
    pool = ["a", "B7", "_", "-", ".", " ", "\n", "é", "ß", "Σ", "σ", "İ", "漢", "́", " ", "　", "ﬁ", "²", "​", "[[", "]]", "[", "]"]
    for k in range(300):
        text = "".join(pool[(k * 7 + i * i * (k % 5 + 1) + i // 3) % (len(pool) - k % 7)] for i in range(k * 2)) + "𝚺😀" * (k % 11 == 0)
        words = text.split()
        assert parse._costs(text, words) == [parse.estimate(w) + 1 for w in words]
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
        assert X.fold_tokens(text) == re.findall(r"[^\W_]+", plain)
        assert [t for t, _ in parse.links(text)] == [t for t in map(str.strip, re.findall(r"\[{2}([^\]]+)\]{2}", text)) if t]


def test_tokens_stay_bytes_and_words_are_counted():
    """Postings made a Python string of every token of every text, and a note's words were split to be counted."""
    pool = ["a", "B7", "_", ".", " ", " ", "\n", "\x1c", "é", "ß", "Σ", "σ", "İ", "漢", "\u0301", "\u2028", "\u3000", "ﬁ", "…", "½", "Ⅷ", "Ǆ", "Å"]
    for k in range(400):
        text = "".join(pool[(k * 7 + i * i * (k % 5 + 1) + i // 3) % (len(pool) - k % 17)] for i in range(k * 2)) + " 𝚺😀" * (k % 11 == 0)
        assert [t.decode() for t in X.folded(text).split(b" ") if t] == X.fold_tokens(text)
        assert parse.word_count(text) == len(text.split())
    assert X.folded("").split() == [] and parse.word_count("") == 0 and parse.word_count("x" * 300) == 1
