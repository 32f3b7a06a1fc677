"""Text functions. Columns where Spark's own expressions have the meaning wanted; Arrow UDFs where only Python has."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; [] for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, of each word of letters and digits; 1 for any other word or mark."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    cost = F.transform(words, lambda w: F.when(w.rlike(r"^[\p{L}\p{N}]+$"), F.floor((F.length(w) + 3) / 4)).otherwise(F.lit(1)).cast("long"))
    return F.coalesce(F.aggregate(cost, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")


def category(path: Column) -> Column:
    """daily, review, work, work/<project> or general, by the path alone."""
    name, parts = F.substring_index(path, "/", -1), F.split(path, "/")
    work = F.when(F.size(parts) > 2, F.concat(F.lit("work/"), F.get(parts, F.lit(1)))).otherwise("work")
    return F.when(name.startswith("day "), "daily").when(name.startswith("review "), "review").when(path.startswith("work/"), work).otherwise("general")


def stem(path: Column) -> Column:
    """The last component without its last extension; a name that only begins with a dot keeps it."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def link_target(raw: Column) -> Column:
    """A link's target without alias and heading."""
    plain = F.substring_index(F.substring_index(raw, "|", 1), "#", 1)
    return F.regexp_replace(F.regexp_replace(plain, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"\\", "/")


def fold_key(value: str) -> str:
    """A note's key: forward slashes, no ``.md``, no leading slash, case folded."""
    key = value.replace("\\", "/").strip()
    if key[-3:].lower() == ".md":
        key = key[:-3]
    return key.lstrip("/").casefold()


# What Spark's regular expressions (Java's) take for a line's end, for the end of a text, and for space around a target.
_BREAK = "\n\r\x85\u2028\u2029"
_END = rf"(?=(?:\r\n|[{_BREAK}])?\Z)"
_SPACE = "\t\n\x0b\f\r"
_AROUND = re.compile(rf"\A[{_SPACE} \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+|[{_SPACE} \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+{_END}")
_SLASHES, _HERE, _LAST, _LAST_ANY = (re.compile(x) for x in (r"/+", r"(?:\A|(?<=/))\./", rf"(?<=[^{_BREAK}])/+{_END}", rf"/+{_END}"))
_SUFFIX = re.compile(rf"(?<=[^{_BREAK}])\.[^.]*\Z")


def folder_of(path: str) -> str:
    """A note's folder, as links are resolved beside it; "" at the root, and where its name has a line's end."""
    folder = path.rpartition("/")[0]
    return "" if any(c in folder for c in _BREAK) else folder


def link_keys(raw: str, folder: str) -> tuple[str | None, str | None, str | None]:
    """What a link of a note in ``folder`` is looked up by: as a path, beside its source, by name. The same keys as ``graph.resolve``'s."""
    target = raw.partition("|")[0].partition("#")[0]
    target = (target.strip(_SPACE + " ") if target.isascii() else _AROUND.sub("", target)).replace("\\", "/")
    if not target:
        return None, None, None
    if "/" not in target:
        return fold_key(target), None, target.casefold()
    clean = _LAST.sub("", _HERE.sub("", _SLASHES.sub("/", target)))
    beside = clean if not folder or target[0] == "/" else f"{folder}/{clean}"
    return fold_key(target), fold_key(beside), _LAST_ANY.sub("", target).rpartition("/")[2].casefold()


def stem_key(path: str) -> str:
    """The name that links find a note by: ``stem``, case folded."""
    return _SUFFIX.sub("", path.rpartition("/")[2]).casefold()


@F.pandas_udf(T.StringType())
def note_key(value: pd.Series) -> pd.Series:
    """``fold_key`` of a column; Spark's lower() isn't case folding (ß, final sigma)."""
    return value.map(fold_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(value: pd.Series) -> pd.Series:
    return value.map(str.casefold, na_action="ignore")


@functools.cache
def _combining() -> tuple[re.Pattern, re.Pattern]:
    """Runs of combining characters: of the first plane, which is a bitmap to the pattern, and of all."""
    found = [re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    return tuple(re.compile("[" + "".join(x for x in found if x <= top) + "]+") for top in ("\uffff", chr(sys.maxunicode)))


def _unaccented(text: str) -> str:
    first, every = _combining()
    plain = unicodedata.normalize("NFKD", text)
    return (every if _BEYOND.search(plain) else first).sub("", plain)


_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_RUN = re.compile(r"[^\W_]+")
_SPACED = {c: " " for c in range(128) if not chr(c).isalnum()}


class _Folded(dict):
    """What each character becomes: without accents, in lower case, a space if it is no letter or digit. A capital sigma,
    whose lower case depends on what comes after it, stays."""

    def __missing__(self, c: int) -> str:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        self[c] = out = "Σ" if "Σ" in plain else "".join(x if x.isalnum() else " " for x in plain.lower())
        return out


_FOLDED = _Folded()


def fold_tokens(text: str) -> list[str]:
    """Case and accents folded; runs of letters and digits (an underscore parts them)."""
    if text.isascii():
        return text.lower().translate(_SPACED).split()
    plain = text.translate(_FOLDED)  # marks that NFKD puts in another order are among those that go
    return _RUN.findall(_unaccented(text).lower()) if "Σ" in plain else plain.split()


_ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_UNKNOWN, _LONGER = (1 << 32) - 1, (1 << 32) - 2
_ONE = np.full(1 << 16, _UNKNOWN, np.uint32)  # what a character of the first plane becomes, where it is one character


def folded(text: str) -> bytes:
    """The tokens of ``fold_tokens`` in UTF-8 with spaces around them, without a Python string for each."""
    if text.isascii():
        return text.encode().translate(_ASCII)
    wide = text.encode("utf-16-le", "surrogatepass")
    if len(wide) == 2 * len(text):
        codes = np.frombuffer(wide, np.uint16)
        plain = _ONE.take(codes)
        if plain.max() == _UNKNOWN:
            for c in np.unique(codes[plain == _UNKNOWN]).tolist():
                x = _FOLDED[c]
                _ONE[c] = _LONGER if "Σ" in x or len(x) != 1 and not x.isspace() else ord(x[0])
            plain = _ONE.take(codes)
        if plain.max() < _LONGER:
            return plain.tobytes().decode("utf-32-le").encode()
    return " ".join(fold_tokens(text)).encode()


def query_phrases(query: str) -> list[list[str]]:
    """A query's words, each as the tokens that have to follow one another; words without tokens count for nothing."""
    return [p for p in (fold_tokens(w) for w in re.findall(r"\w+", query)) if p]


def snippet(text: str, phrases: list[list[str]], width: int = 24) -> str:
    """About ``width`` tokens around the densest matches, which are in brackets; dots where text is left out."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    folded = [(fold_tokens(text[a:b]) or [""])[0] for a, b in spans]
    hits = set()
    for p in phrases:
        for i in range(len(folded) - len(p) + 1):
            if folded[i : i + len(p)] == p:
                hits.update(range(i, i + len(p)))
    if not spans:
        return text
    first = max(sorted({max(0, h) for h in hits} or {0}), key=lambda s: sum(s <= h < s + width for h in hits))
    first = max(0, min(first, len(spans) - width))
    last = min(len(spans), first + width)
    out, at = [], spans[first][0] if first else 0
    for i in range(first, last):
        a, b = spans[i]
        out += [text[at:a], f"[{text[a:b]}]" if i in hits else text[a:b]]
        at = b
    tail = text[at:] if last == len(spans) else "..."
    return ("..." if first else "") + "".join(out) + tail


def relative_humidity_after(t1: Column, rh1: Column, t2: Column) -> Column:
    """Relative humidity (percent, 2 places) of air at t1 °C and rh1 percent once it is warmed to t2 °C (Magnus)."""

    def vapour(t: Column) -> Column:
        return F.lit(6.112) * F.exp(F.lit(17.62) * t / (F.lit(243.12) + t))

    return F.round(rh1 * vapour(t1) / vapour(t2), 2)
