"""One note's text to its rows. Plain Python: these rules are about Python's notion of lines, spaces and digits."""

from __future__ import annotations

import functools
import hashlib
import re
import string
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np

BUDGET, OVERLAP = 360, 40
_FENCE_END = re.compile(r"\n-{3}\s*(?:\n|\Z)")
_DASH, _LINE_END = r"\s*-\s*", r"\s*\n?"
_NUMBER_ITEM, _TEXT_ITEM = (re.compile(_DASH + what + _LINE_END) for what in (r"\d+", r"[^\n]+"))
_LINK = re.compile(r"\[{2}([^\]]+)\]{2}")
_MARKS = frozenset(string.punctuation) - {"_"}
_PIECE = re.compile(r"[^\w\s]|\w+")


class Front(NamedTuple):
    energy: int | None
    sentiment: float | None
    labels: list[str]
    tags: list[str]
    body: str
    line: int


class Chunk(NamedTuple):
    ordinal: int
    index: int
    heading: str
    line: int
    text: str

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.text.encode("utf-8", "ignore")).hexdigest()


def text_of(raw: bytes) -> str:
    """UTF-8 without the bytes that aren't; every kind of line end is a newline."""
    return raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def _head(content: str) -> tuple[str, int] | None:
    """The frontmatter's inside and where the body begins. The opening fence takes as many blank lines as it can."""
    if not content.startswith("---"):
        return None
    blank = len(content) - len(content[3:].lstrip())
    for at in range(blank - 1, 2, -1):
        if content[at] == "\n" and (end := _FENCE_END.search(content, at + 1)):
            return content[at + 1 : end.start()], end.end()
    return None


def _items(head: str, key: str, item: re.Pattern) -> str:
    """The block list under ``key``, as it stands; "" without one."""
    for m in re.finditer(rf"(?m)^{key}:\s*\n", head):
        at = m.end()
        while (got := item.match(head, at)) and got.end() > at:
            at = got.end()
        if at > m.end():
            return head[m.end() : at]
    return ""


def _strings(block: str) -> list[str]:
    return [x.strip("- ").strip() for x in block.strip().splitlines()]


def front(content: str) -> Front:
    found = _head(content)
    if found is None:
        return Front(None, None, [], [], content, 1)
    head, at = found
    energy = re.search(r"(?m)^energy:\s*(\d+)", head)
    numbers = [int(n) for n in re.findall(r"\d+", _items(head, "sentiment", _NUMBER_ITEM))]
    return Front(
        int(energy[1]) if energy else None,
        sum(numbers) / len(numbers) if numbers else None,
        _strings(_items(head, "sentiment-label", _TEXT_ITEM)),
        _strings(_items(head, "tags", _TEXT_ITEM)),
        content[at:],
        content.count("\n", 0, at) + 1,
    )


def key_lines(body: str, most: int = 15) -> str:
    lines = [x for x in map(str.strip, body.splitlines()) if x.startswith(("#", "- "))]
    return "\n".join(x if len(x) <= 200 else f"{x[:200]}..." for x in lines[:most])


def links(content: str) -> list[tuple[str, int]]:
    """(raw target, line) of each link of the whole content, frontmatter and code included."""
    out, line, at, near = [], 1, 0, content.find("[[")
    while near >= 0:
        if (m := _LINK.match(content, near)) is None:
            near = content.find("[[", near + 1)
            continue
        line, at = line + content.count("\n", at, near), near
        if target := m[1].strip():
            out.append((target, line))
        near = content.find("[[", m.end())
    return out


class Part(NamedTuple):
    heading: str
    line: int
    text: str


def sections(stem: str, body: str, line: int) -> list[Part]:
    """(heading, line, text) at each second-level heading; what comes before has the stem as its heading."""
    rows, out = body.splitlines(), []
    marks = [i for i, x in enumerate(rows) if x[:3] == "## "]
    lead = "\n".join(rows[: marks[0]] if marks else rows) if marks else body
    if lead := lead.strip():
        out.append(Part(stem, line, lead))
    for i, end in zip(marks, [*marks[1:], len(rows)]):
        heading = rows[i][3:].strip() or stem
        out.append(Part(heading, line + i, "\n".join(rows[i + 1 : end]).strip() or heading))
    return out


def estimate(text: str) -> int:
    return sum(max(1, -(-len(p) // 4)) if p.isalnum() or p == "_" else 1 for p in _PIECE.findall(text))


class _Costs(dict):
    """Each word's cost in a window; short words are kept, 65,536 of them at most."""

    def __missing__(self, word: str) -> int:
        n = len(word)
        if word.isalnum():  # one piece
            cost = (n + 3) // 4 + 1
        elif word[-1] in _MARKS and word[:-1].isalnum():  # one and a mark
            cost = (n + 2) // 4 + 2
        else:
            cost = estimate(word) + 1
        if n < 40:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = cost
        return cost


_COSTS = _Costs()


def windows(costs: list[int], start_cost: int) -> list[tuple[int, int]]:
    """[first, last) word ranges within the budget, each beginning with up to OVERLAP of the one before."""
    out, lo, n, upto = [], 0, len(costs), list(accumulate(costs, initial=0))  # every word costs something
    while lo < n:
        hi = max(lo + 1, bisect_right(upto, upto[lo] + BUDGET - start_cost) - 1)
        out.append((lo, hi))
        if hi == n:
            break
        lo = max(lo + 1, bisect_left(upto, upto[hi] - OVERLAP))
    return out


@functools.cache
def _kinds() -> np.ndarray:
    """Of the first plane's characters: 0 a space, 1 a letter or digit, 2 the underscore, 3 any other."""
    return np.array([0 if c.isspace() else 1 if c.isalnum() else 2 if c == "_" else 3 for c in map(chr, range(1 << 16))], np.uint8)


def word_count(text: str) -> int:
    """The words of ``text``; of longer texts counted by where they begin, none is made."""
    wide = text.encode("utf-16-le", "surrogatepass") if len(text) > 200 else b""
    if len(wide) != 2 * len(text):
        return len(text.split())
    inside = _kinds().take(np.frombuffer(wide, np.uint16)) != 0
    return int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] > inside[:-1]))


def _costs(content: str, words: list[str]) -> list[int]:
    """``_COSTS`` of the words of ``content``; of longer texts from the kinds of their characters, all at once."""
    if len(words) < 32:
        return list(map(_COSTS.__getitem__, words))
    wide = content.encode("utf-16-le", "surrogatepass")
    if len(wide) != 2 * len(content):  # there are others than those of the first plane
        return list(map(_COSTS.__getitem__, words))
    kind = np.zeros(len(content) + 2, np.uint8)  # a space before and after
    kind[1:-1] = _kinds().take(np.frombuffer(wide, np.uint16))
    piece = (kind == 1) | (kind == 2)
    edges = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    cost = (kind == 3).astype(np.int32)
    cost[begin] = (end - begin + 3) // 4
    if "_" in content:
        marked = np.cumsum(kind == 2)
        cost[begin[marked[end - 1] > marked[begin - 1]]] = 1
    starts = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0)) + 1
    return (np.add.reduceat(cost, starts) + 1).tolist()


def chunk_texts(title: str, content: str) -> list[str]:
    """Chunks of a section, each headed by its title."""
    name, words = title.strip() or "Untitled", content.split()
    costs = _costs(content, words)
    start = estimate(name) + 1
    if start + sum(costs) - len(words) - 1 <= BUDGET:  # no piece goes over a space, so a text costs what its words do
        return [f"{name}\n{' '.join(words)}"]
    return [f"{name}\n{' '.join(words[a:b])}" for a, b in windows(costs, start)]


def chunks(stem: str, body: str, line: int) -> list[Chunk]:
    return [Chunk(k, i, heading, at, text) for k, (heading, at, part) in enumerate(sections(stem, body, line)) for i, text in enumerate(chunk_texts(heading, part))]
