"""Language ID of mixed-language text: script ranges, then Viterbi over per-word scores with a switching penalty.

Each word has a script (by the code points of its characters). Where a script leaves one language, that is its only
candidate; the languages that share a script compete by the log-likelihood of the word's character trigrams
(bytes, folded, with the word's borders), learned from labelled texts. A label's scripts are those that at least
``OWN`` of its words have. A script that no label has goes to the language that ``SCRIPTS`` names; letters of scripts
that aren't listed go to no language (``und``). ``und`` competes with every one: it has the score of a word that no
language knows. Viterbi finds the best sequence of languages when each switch costs ``SWITCH``; words without letters
(digits, symbols) score alike for all and take the language around them.

The dynamic programme runs over all texts at once. Texts are cut into blocks of ``BLOCK`` words; one pass computes,
for each block and each language before it, the best score of every language after it; a short pass over the blocks
joins those, and a last pass traces each block from the language that is then known at its end. The result is that
of the plain sequence, whatever the text's length.

Training counts trigrams in at most ``SAMPLE`` different texts of each label, the first by a hash of the text (a
documented bound; the texts may have any length, every text is labelled, and there may be any number of labels). The
tasks count, the driver gets sums by label and trigram. Rows whose label is null or ``und`` are left out; without any
labelled text only scripts decide.

Rows: a null or empty text, or one without words, has null language, share 0 and no spans; one without letters is
``und``. Very long texts are labelled whole. Repeated rows and null ids have their results each. Ties go to the
language that is first by name. An empty table gives no rows. Only the id, text and label columns are read, so that
names that clash with those of results are safe; ``filter_language`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomnote.llm import spans

SAMPLE = 400
SWITCH = 12.0
BLOCK = 256
BITS = 17
OWN = 0.1
#: Cost of each Han word for Japanese where labels say nothing of the script, so that Han between kana stays Japanese.
HAN_IN_JAPANESE = -1.0
#: Numbers (of languages before and after) that the programme over blocks holds at once.
MOVES = 1 << 23
UND = "und"
#: First code point, last, script, its language where no labelled text has another.
SCRIPTS = [
    (0x0041, 0x024F, "Latn", None), (0x0250, 0x02AF, "Latn", None), (0x1E00, 0x1EFF, "Latn", None), (0x2C60, 0x2C7F, "Latn", None), (0xA720, 0xA7FF, "Latn", None), (0xAB30, 0xAB6F, "Latn", None), (0xFB00, 0xFB06, "Latn", None), (0xFF21, 0xFF5A, "Latn", None),
    (0x0370, 0x03FF, "Grek", "el"), (0x1F00, 0x1FFF, "Grek", "el"), (0x0400, 0x052F, "Cyrl", "ru"), (0x1C80, 0x1C8F, "Cyrl", "ru"), (0x2DE0, 0x2DFF, "Cyrl", "ru"), (0xA640, 0xA69F, "Cyrl", "ru"), (0x0530, 0x058F, "Armn", "hy"), (0xFB13, 0xFB17, "Armn", "hy"),
    (0x0590, 0x05FF, "Hebr", "he"), (0xFB1D, 0xFB4F, "Hebr", "he"), (0x0600, 0x06FF, "Arab", "ar"), (0x0750, 0x077F, "Arab", "ar"), (0x0870, 0x08FF, "Arab", "ar"), (0xFB50, 0xFDFF, "Arab", "ar"), (0xFE70, 0xFEFE, "Arab", "ar"),
    (0x0700, 0x074F, "Syrc", "syr"), (0x0780, 0x07BF, "Thaa", "dv"), (0x07C0, 0x07FF, "Nkoo", "nqo"), (0x0900, 0x097F, "Deva", "hi"), (0xA8E0, 0xA8FF, "Deva", "hi"), (0x0980, 0x09FF, "Beng", "bn"), (0x0A00, 0x0A7F, "Guru", "pa"), (0x0A80, 0x0AFF, "Gujr", "gu"),
    (0x0B00, 0x0B7F, "Orya", "or"), (0x0B80, 0x0BFF, "Taml", "ta"), (0x0C00, 0x0C7F, "Telu", "te"), (0x0C80, 0x0CFF, "Knda", "kn"), (0x0D00, 0x0D7F, "Mlym", "ml"), (0x0D80, 0x0DFF, "Sinh", "si"), (0x0E00, 0x0E7F, "Thai", "th"), (0x0E80, 0x0EFF, "Laoo", "lo"),
    (0x0F00, 0x0FFF, "Tibt", "bo"), (0x1000, 0x109F, "Mymr", "my"), (0xA9E0, 0xA9FF, "Mymr", "my"), (0xAA60, 0xAA7F, "Mymr", "my"), (0x10A0, 0x10FF, "Geor", "ka"), (0x1C90, 0x1CBF, "Geor", "ka"), (0x2D00, 0x2D2F, "Geor", "ka"),
    (0x1200, 0x139F, "Ethi", "am"), (0x2D80, 0x2DDF, "Ethi", "am"), (0xAB00, 0xAB2F, "Ethi", "am"), (0x13A0, 0x13FF, "Cher", "chr"), (0xAB70, 0xABBF, "Cher", "chr"), (0x1400, 0x167F, "Cans", "iu"), (0x1780, 0x17FF, "Khmr", "km"), (0x19E0, 0x19FF, "Khmr", "km"),
    (0x1800, 0x18AF, "Mong", "mn"), (0x2D30, 0x2D7F, "Tfng", "zgh"), (0xA000, 0xA4CF, "Yiii", "ii"), (0xA980, 0xA9DF, "Java", "jv"), (0x1B00, 0x1B7F, "Bali", "ban"), (0x1C50, 0x1C7F, "Olck", "sat"), (0xABC0, 0xABFF, "Mtei", "mni"),
    (0x1100, 0x11FF, "Hang", "ko"), (0x3130, 0x318F, "Hang", "ko"), (0xA960, 0xA97F, "Hang", "ko"), (0xAC00, 0xD7FF, "Hang", "ko"), (0x3041, 0x30FF, "Kana", "ja"), (0x31F0, 0x31FF, "Kana", "ja"), (0xFF66, 0xFF9F, "Kana", "ja"),
    (0x3105, 0x312F, "Hani", "zh"), (0x31A0, 0x31BF, "Hani", "zh"), (0x3400, 0x4DBF, "Hani", "zh"), (0x4E00, 0x9FFF, "Hani", "zh"), (0xF900, 0xFAFF, "Hani", "zh"), (0x20000, 0x3FFFF, "Hani", "zh"),
]
OTHER = "Zzzz"
NAMES = ["", OTHER, *sorted({s for _, _, s, _ in SCRIPTS if s != "Kana"}), "Kana"]  # the highest of a word's scripts counts: kana beside Han is Japanese
LATIN = NAMES.index("Latn")
_edges, _kinds = [0], [0]
for _a, _b, _s, _ in sorted(SCRIPTS):
    _edges += [_a, _b + 1]
    _kinds += [NAMES.index(_s), 0]
_EDGES, _KINDS = np.array(_edges), np.array(_kinds, dtype=np.int8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Words:
    """The words of a run of texts: where they are, their texts, and the script of each (0: digits only)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = spans.fold_case(data)
        self.mask = spans.word_mask(self.data)
        self.starts, self.ends = spans.runs(self.mask, offsets)
        self.at = np.searchsorted(self.starts, offsets)
        kind = np.where(_LETTER[self.data], LATIN, 0).astype(np.int8)
        lead, _, cp = spans.code_points(self.data)
        if len(lead):
            listed = _KINDS[np.searchsorted(_EDGES, cp, side="right") - 1]
            kind[lead] = np.where((listed == 0) & (spans.classes()[cp] == spans.LETTER), 1, listed)
        if len(self.starts):
            kind[~self.mask] = 0
            self.script = np.maximum.reduceat(kind, self.starts)
        else:
            self.script = np.zeros(0, dtype=np.int8)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of the trigram around each byte of a word, and where each word's begin."""
        b = np.where(self.mask, self.data, 32).astype(np.uint32)
        g = b << np.uint32(8)
        g[1:] |= b[:-1] << np.uint32(16)
        g[0] |= np.uint32(32 << 16)
        g[:-1] |= b[1:]
        g[-1] |= np.uint32(32)
        before = np.zeros(len(b), dtype=bool)  # a text's first and last byte see a border, not the next text
        before[self.starts] = True
        g[before] = g[before] & np.uint32(0x00FFFF) | np.uint32(32 << 16)
        last = self.ends - 1
        g[last] = g[last] & np.uint32(0xFFFF00) | np.uint32(32)
        g = (g * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)[self.mask]
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        return g, at


class Model:
    """languages: sorted, ``und`` last; of each script the candidates; table (trained, 2**BITS) of log-likelihoods."""

    def __init__(self, trained: list[str], table: np.ndarray, home: list[set[int]], floor: float):
        self.trained, self.table, self.floor = trained, table, floor
        single = {s: lang for _, _, s, lang in SCRIPTS if lang}
        taken = {NAMES[k] for h in home for k in h}
        others = sorted({lang for s, lang in single.items() if s not in taken and lang not in trained})
        self.languages = [*sorted([*trained, *others]), UND]
        at = {name: i for i, name in enumerate(self.languages)}
        self.column = [at[t] for t in trained]
        self.candidates = np.zeros((len(NAMES), len(self.languages)), dtype=bool)
        self.candidates[:, -1] = True
        for t, h in zip(trained, home):
            self.candidates[sorted(h), at[t]] = True
        for s, lang in single.items():
            if s not in taken and lang in at:
                self.candidates[NAMES.index(s), at[lang]] = True
        self.candidates[0] = True
        self.han = at["ja"] if "Hani" not in taken and "ja" in others else -1
        if self.han >= 0:
            self.candidates[NAMES.index("Hani"), self.han] = True

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages) log-likelihoods; -1e6 where the script rules a language out."""
        grams, at = words.trigrams()
        n = at[1:] - at[:-1]
        out = np.full((len(n), len(self.languages)), -1e6, dtype=np.float32)
        if not len(n):
            return out
        out[:, -1] = self.floor * n
        trained = np.zeros(len(self.languages), dtype=bool)
        for k, c in enumerate(self.column):
            trained[c] = True
            out[:, c] = np.add.reduceat(self.table[k][grams], at[:-1])
        fits = self.candidates[words.script]
        alone = fits & ~trained
        alone[:, -1] = False
        out[alone] = 0
        if self.han >= 0:
            out[words.script == NAMES.index("Hani"), self.han] = HAN_IN_JAPANESE
        out[~fits] = -1e6
        out[words.script == 0] = 0
        return out


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of each trigram bucket, of each script) in texts."""
    grams, kinds = np.zeros(1 << BITS, dtype=np.int64), np.zeros(len(NAMES), dtype=np.int64)
    for _, _, data, offsets in spans.chunks(column):
        w = Words(data, offsets)
        if len(w.starts):
            grams += np.bincount(w.trigrams()[0], minlength=1 << BITS)
            kinds += np.bincount(w.script, minlength=len(NAMES))
    return grams, kinds


def model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of (trigram counts, script counts) by label."""
    trained, home, rows, seen = sorted(x for x in counts if x != UND), [], [], []
    for name in trained:
        c, kind = counts[name][0].astype(np.float64), counts[name][1].astype(np.float64)
        kind[0] = kind[1] = 0
        home.append({int(k) for k in np.flatnonzero(kind >= OWN * kind.sum())} if kind.any() else {LATIN})
        rows.append(np.log((c + 0.5) / (c.sum() + 0.5 * 8192)).astype(np.float32))
        if c.sum():
            seen.append(float((c * rows[-1]).sum() / c.sum()))
    table = np.stack(rows) if rows else np.zeros((0, 1 << BITS), np.float32)
    return Model(trained, table, home, min(seen, default=0.0) - 3.0)


def fit(texts: list[str | None], labels: list[str]) -> Model:
    """Count trigrams of labelled texts."""
    return model({name: counted(pa.array([t for t, x in zip(texts, labels) if x == name], pa.large_string())) for name in sorted(set(labels))})


def sampled(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text): at most ``sample`` different texts of each label, the first by a hash of the text."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text != ''")
    h = rows.select("lang", F.xxhash64("text").alias("h")).distinct()  # copies of a text count once
    top = h.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= sample)
    limit = top.groupBy("lang").agg(F.max("h").alias("most")).collect()
    limit = docs.sparkSession.createDataFrame(limit, "lang string, most long")
    # a row for each label is broadcast, of which the model holds a whole table
    found = rows.join(F.broadcast(limit), "lang").where(F.xxhash64("text") <= F.col("most"))
    return found.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.any_value("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams and scripts of the sampled texts in tasks; the driver gets the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                grams, kinds = counted(batch.column(1).filter(pa.array(np.asarray(langs.indices) == k)))
                g, s = np.flatnonzero(grams), np.flatnonzero(kinds)
                bucket = np.concatenate([g, -1 - s])  # scripts below zero
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(np.concatenate([grams[g], kinds[s]]), pa.int64())], names=["lang", "bucket", "n"])

    sums = sampled(docs, sample, text_col, lang_col).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    langs = sums.column("lang").combine_chunks().dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    bucket, n, code = np.asarray(sums.column("bucket")), np.asarray(sums.column("n")), np.asarray(langs.indices)
    for k, name in enumerate(langs.dictionary.to_pylist()):
        grams, kinds = np.zeros(1 << BITS, dtype=np.int64), np.zeros(len(NAMES), dtype=np.int64)
        b, c = bucket[code == k], n[code == k]
        grams[b[b >= 0]] = c[b >= 0]
        kinds[-1 - b[b < 0]] = c[b < 0]
        out[name] = grams, kinds
    return model(out)


def viterbi(score: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; words at[i]:at[i + 1] are a sequence."""
    n, k = score.shape
    if not n:
        return np.zeros(0, dtype=np.int32)
    count = np.diff(at)
    blocks = -(-count // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])  # of each text's blocks
    begin = np.repeat(at[:-1], blocks) + BLOCK * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    length = np.minimum(BLOCK, np.repeat(at[1:], blocks) - begin)
    entry = np.zeros((len(begin), k), dtype=np.float32)  # best score of each language before the block's first word
    known = np.full(len(begin), -1, dtype=np.int64)  # language at its end, once known
    many = np.flatnonzero(blocks > 1)
    many = many[np.argsort(-blocks[many], kind="stable")]
    group = max(1, MOVES // (k * k))
    for lo in range(0, len(many), group):
        _join(score, many[lo : lo + group], blocks, first, begin, length, np.float32(switch), entry, known)
    order = np.argsort(-length, kind="stable")
    begin, length, entry, known = begin[order], length[order], entry[order], known[order]
    out = np.empty(n, dtype=np.int32)
    step = max(1, min(8192, (MOVES << 3) // (BLOCK * k)))
    for lo in range(0, len(begin), step):
        _trace(score, begin[lo : lo + step], length[lo : lo + step], entry[lo : lo + step], known[lo : lo + step], np.float32(switch), out)
    return out


def _join(score: np.ndarray, texts: np.ndarray, blocks: np.ndarray, first: np.ndarray, begin: np.ndarray, length: np.ndarray, switch: np.float32, entry: np.ndarray, known: np.ndarray) -> None:
    """Fill in ``entry`` and ``known`` for the blocks of texts (those with most blocks first), a slab of blocks at a time."""
    k, most, trail = score.shape[1], int(blocks[texts[0]]), []
    lives = np.searchsorted(-blocks[texts], -np.arange(most))  # texts that have an s-th block
    state = np.zeros((len(texts), k), dtype=np.float64)
    slab = max(1, MOVES // (k * k * len(texts)))
    for s0 in range(0, most, slab):
        steps = range(s0, min(most, s0 + slab))
        inner = np.concatenate([first[texts[: lives[s]]] + s for s in steps])
        move = _moves(score, begin[inner], length[inner], switch)
        done = 0
        for s in steps:
            live = int(lives[s])
            b, m = inner[done : done + live], move[done : done + live]
            done += live
            entry[b] = (state[:live] - state[:live].max(axis=1, keepdims=True)).astype(np.float32)
            total = entry[b].astype(np.float64)[:, :, None] + m
            trail.append(total.argmax(axis=1))
            state[:live] = total.max(axis=1)
    end = np.zeros(len(texts), dtype=np.int64)
    for s in range(most - 1, -1, -1):
        live = int(lives[s])
        last = blocks[texts[:live]] == s + 1
        end[:live][last] = state[:live][last].argmax(axis=1)
        known[first[texts[:live]] + s] = end[:live]
        end[:live] = trail[s][np.arange(live), end[:live]]


def _moves(score: np.ndarray, begin: np.ndarray, length: np.ndarray, switch: np.float32) -> np.ndarray:
    """(blocks, from, to): the best score within each block, from the language before it to the one at its end."""
    k, order = score.shape[1], np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    move = np.full((len(begin), k, k), -switch, dtype=np.float32)
    move[:, np.arange(k), np.arange(k)] = 0
    for t in range(int(length[0])):
        v = move[: int(np.searchsorted(-length, -t))]
        np.maximum(v, v.max(axis=2, keepdims=True) - switch, out=v)
        v += score[begin[: len(v)] + t][:, None, :]
    out = np.empty_like(move)
    out[order] = move
    return out


def _trace(score: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray, known: np.ndarray, switch: np.float32, out: np.ndarray) -> None:
    """Fill in the languages of blocks, longest first, from their entry scores and the language at their end."""
    most = int(length[0])
    state = entry.copy()
    stay = np.empty((most, len(begin)), dtype=np.int32)  # where to come from after a switch
    held = np.zeros((most, *entry.shape), dtype=bool)
    lives = np.searchsorted(-length, -np.arange(most))
    for t in range(most):
        v = state[: lives[t]]
        top = v.argmax(axis=1)
        jump = v[np.arange(len(v)), top] - switch
        held[t, : lives[t]] = v >= jump[:, None]
        stay[t, : lives[t]] = top
        np.maximum(v, jump[:, None], out=v)
        v += score[begin[: lives[t]] + t]
    now = np.where(known >= 0, known, state.argmax(axis=1))
    for t in range(most - 1, -1, -1):
        live = lives[t]
        c = now[:live]
        out[begin[:live] + t] = c
        now[:live] = np.where(held[t, :live][np.arange(live), c], c, stay[t, :live])


def label_words(model: Model, data: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> tuple[Words, np.ndarray]:
    """The words and the language of each. A text's programme has only the languages that its scripts leave."""
    words = Words(data, offsets)
    n, at = len(words.script), words.at
    label = np.full(n, len(model.languages) - 1, dtype=np.int32)
    if not n:
        return words, label
    score = model.scores(words)
    bits = (np.int64(1) << words.script.astype(np.int64)) & ~np.int64(1)
    filled = np.flatnonzero(np.diff(at))
    scripts = np.zeros(len(at) - 1, dtype=np.int64)
    scripts[filled] = np.bitwise_or.reduceat(bits, at[filled])
    for mask in np.unique(scripts[filled]).tolist():
        if not mask:  # digits only: no language
            continue
        columns = np.flatnonzero(model.candidates[[k for k in range(1, len(NAMES)) if mask >> k & 1]].any(axis=0))
        rows = scripts == mask
        if rows.all():
            label = columns[viterbi(score[:, columns], at, switch)].astype(np.int32)
        else:
            count = np.diff(at)
            mine = np.flatnonzero(np.repeat(rows, count))
            label[mine] = columns[viterbi(score[np.ix_(mine, columns)], np.concatenate([[0], np.cumsum(count[rows])]), switch)]
    return words, label


def _shares(model: Model, label: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, share of the words) that most words of each text have."""
    n, k = len(at) - 1, len(model.languages)
    row = np.repeat(np.arange(n), np.diff(at))
    count = np.bincount(row * k + label, minlength=n * k).reshape(n, k)
    best = count.argmax(axis=1)
    return best, count[np.arange(n), best] / np.maximum(np.diff(at), 1)


def detect(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_found, share, n_words, span_langs, span_ends): spans are runs of words of one language, in order.

    ``span_ends`` has the number of words up to the end of each span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_found", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("span_langs", T.ArrayType(T.StringType())), T.StructField("span_ends", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages)
        for batch in batches:
            for i, j, data, offsets in spans.chunks(batch.column(1)):
                words, label = label_words(m, data, offsets, switch)
                at = words.at
                best, share = _shares(m, label, at)
                count = np.diff(at)
                last = np.zeros(len(label), dtype=bool)
                last[:-1] = label[1:] != label[:-1]
                last[at[1:][count > 0] - 1] = True
                end = np.flatnonzero(last)
                cuts = pa.array(np.searchsorted(end, at), pa.int32())
                ends = end + 1 - np.repeat(at[:-1], np.diff(np.searchsorted(end, at)))
                lang = names.take(pa.array(best, mask=count == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lang, pa.array(np.where(count, share, 0.0)), pa.array(count), pa.ListArray.from_arrays(cuts, names.take(pa.array(label[end]))), pa.ListArray.from_arrays(cuts, pa.array(ends, pa.int32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def filter_language(docs: DataFrame, model: Model, least_share: float = 0.3, allowed: list[str] | None = None, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose main language is known (or ``allowed``) and has ``least_share`` of the words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        good = np.array([x != UND and (allowed is None or x in allowed) for x in m.languages])
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, j, data, offsets in spans.chunks(pc.cast(batch.column(place), pa.string())):
                words, label = label_words(m, data, offsets, switch)
                best, share = _shares(m, label, words.at)
                keep[i:j] = good[best] & (share >= least_share) & (np.diff(words.at) > 0)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
