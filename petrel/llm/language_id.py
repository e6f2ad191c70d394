"""Language identification of whole texts and of the spans inside them.

Every word gets a score for each language: the summed log-likelihood ratios of its byte
n-grams (2, 3 and 4 bytes, the edges of the word included) under naive Bayes models
learned from labelled rows.  The script of a word, found by ranges of its code points,
first narrows which languages may claim it; what belongs to no script ends a word.  Viterbi over the words, with a penalty for each switch, labels
spans; a text's language is the one whose spans hold the most letters' bytes, its score
their share.  All of it runs over Arrow buffers: hashing, scoring and the Viterbi steps
of all texts of a batch at once.

Learning takes at most ``per_language`` rows of each language (1,500 unless told
otherwise), those with the least hashes of their ids, so the model's cost does not grow
with the corpus; whole texts are used.  Prediction covers every row and text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so are all
when nothing can be learned; ties go to the language that sorts first; null or repeated
ids and very long texts are ordinary rows; words in a script that no language was seen
with may be any language's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import wordkernel as wk

GRAMS = (2, 3, 4)
BITS = 16
SIZE = 1 << BITS
#: First and last code points of scripts' letters, from the Unicode block chart.  What lies outside (quotes,
#: dashes, symbols, digits, CJK punctuation) belongs to no script and ends a word; marks that combine with any letter stay.
SCRIPTS = {
    "marks": [(0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x200C, 0x200D), (0x20D0, 0x20FF), (0xFE00, 0xFE0F)],
    "latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0x00AA, 0x00AA), (0x00B5, 0x00B5), (0x00BA, 0x00BA), (0x00C0, 0x00D6), (0x00D8, 0x00F6), (0x00F8, 0x02FF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x0370, 0x037D), (0x037F, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0531, 0x0556), (0x0560, 0x0588), (0xFB13, 0xFB17)],
    "hebrew": [(0x0591, 0x05BD), (0x05BF, 0x05F2), (0xFB1D, 0xFB4F)],
    "arabic": [(0x0610, 0x061A), (0x0620, 0x065F), (0x066E, 0x06D3), (0x06D5, 0x06EF), (0x06FA, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)],
    "syriac": [(0x0700, 0x074F), (0x0780, 0x07BF)],
    "indic": [(0x0900, 0x0963), (0x0971, 0x0DFF)],
    "southeast": [(0x0E00, 0x0E4E), (0x0E80, 0x0ECF), (0x0F00, 0x109F), (0x1780, 0x17D3), (0x1980, 0x1A1F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "kana": [(0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3100, 0x312F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
    "other": [(0x07C0, 0x085F), (0x13A0, 0x177F), (0x1800, 0x18FF), (0x1A20, 0x1AAF), (0x1B00, 0x1C7F), (0x1CD0, 0x1CFF), (0xA000, 0xA63F), (0xA6A0, 0xA71F), (0xA800, 0xA95F), (0xA980, 0xAB2F), (0xAB70, 0xABFF), (0x10000, 0x1CFFF), (0x1E000, 0x1EFFF)],
}
_RANGES = sorted((first, last, number) for number, ranges in enumerate(SCRIPTS.values(), 1) for first, last in ranges)
_EDGES = {last + 1: 0 for _, last, _ in _RANGES} | {first: number for first, _, number in _RANGES}
EDGE_AT, EDGE_SCRIPT = np.array([0, *sorted(_EDGES)]), np.array([0, *(_EDGES[x] for x in sorted(_EDGES))], np.int8)


def script_of(points: np.ndarray) -> np.ndarray:
    """Number of each code point's script, 0 for none."""
    return EDGE_SCRIPT[np.searchsorted(EDGE_AT, points, side="right") - 1]


def wide_scripts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters beyond ASCII in UTF-8 bytes: where they begin, their bytes, and their scripts."""
    lead = np.flatnonzero(raw >= 0xC0)
    first = raw[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    point = first & (0x7F >> size)
    for i in range(1, 4):
        point = np.where(size > i, (point << 6) | (padded[lead + i] & 0x3F), point)
    return lead, size, script_of(point)


FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
LATIN = list(SCRIPTS).index("latin") + 1
FORBIDDEN = -50.0


class Batch:
    """Words of some rows: their row, bytes of letters, script, and where their n-grams lie."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        row = np.repeat(np.arange(n), np.diff(off))
        # A space before each row and three after the last: no n-gram reaches into another row.
        self.text = np.full(len(raw) + n + 4, 32, np.uint8)
        at = np.arange(len(raw)) + row + 1
        self.text[at] = FOLD[raw]
        lead, size, wide = wide_scripts(raw)
        for i in range(4):  # a character of no script ends a word, all its bytes
            self.text[at[lead[(wide == 0) & (size > i)] + i]] = 32
        letter = self.text != 32
        script = np.where(letter & (self.text < 128), np.int8(LATIN), np.int8(0))
        script[at[lead]] = wide
        start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.letter, self.start = letter, start
        bound = off + np.arange(n + 1)
        self.first = np.searchsorted(start, bound)
        if len(start):
            self.letters = np.add.reduceat(letter.astype(np.int64), start)
            self.script = np.maximum.reduceat(script, start)
        else:
            self.letters, self.script = np.zeros(0, np.int64), np.zeros(0, np.int8)

    def grams(self):
        """For each n-gram length: the hash of the gram at each byte, and which bytes start one."""
        b, x = self.text.astype(np.uint32), self.letter
        m = len(b) - 3
        g = b[:m] | (b[1 : m + 1] << np.uint32(8))
        mul = np.uint32(0x9E3779B1)
        yield 0, (g * mul) >> np.uint32(32 - BITS), x[:m] | x[1 : m + 1]
        g = g | (b[2 : m + 2] << np.uint32(16))
        yield 1, (g * mul) >> np.uint32(32 - BITS), x[1 : m + 1]
        g = g | (b[3 : m + 3] << np.uint32(24))
        yield 2, (g * mul) >> np.uint32(32 - BITS), x[1 : m + 1] & x[2 : m + 2]


def _count(batches):
    """(lang, order, cells, counts): n-gram counts of a task by language, sparse; order -1: scripts' letters."""
    total: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for (langs,), raw, off in wk.slices([batch.column(0)], batch.column(1)):
            names = np.array(langs.to_pylist(), dtype=object)
            for lang in sorted(set(names)):
                mine = np.flatnonzero(names == lang)
                part = np.concatenate([raw[off[r] : off[r + 1]] for r in mine])
                data = Batch(part, np.concatenate([[0], np.cumsum([off[r + 1] - off[r] for r in mine])]))
                c = total.setdefault(lang, np.zeros((len(GRAMS), SIZE), np.int64))
                for k, g, real in data.grams():
                    c[k] += np.bincount(g[real], minlength=SIZE)
                s = scripts.setdefault(lang, np.zeros(len(SCRIPTS) + 1, np.int64))
                s += np.bincount(data.script, weights=data.letters, minlength=len(s)).astype(np.int64)
    out = []
    for lang, c in total.items():
        out.append((lang, -1, np.arange(len(scripts[lang]), dtype=np.int32).tobytes(), scripts[lang].tobytes()))
        for k in range(len(GRAMS)):
            cells = np.flatnonzero(c[k])
            out.append((lang, k, cells.astype(np.int32).tobytes(), c[k][cells].tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=pa.schema([("lang", pa.string()), ("k", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, most_languages: int = 1000) -> dict:
    """The model: languages, n-gram tables and allowed scripts, from a bounded sample of the usable rows."""
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.abs(F.xxhash64(F.lit(5), F.col(id_col)) % 1_000_003).alias("dice"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}  # a row per language
    if len(sizes) > most_languages:
        raise ValueError(f"more languages than a model holds (most_languages, {most_languages})")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n) * 1_000_003)]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    sample = rows.where(F.col("dice") < share[F.col("lang")]).select("lang", "text").limit(2 * per_language * max(1, len(sizes)))
    counted = wk.over_texts(sample.repartition(8), _count, "lang string, k int, cells binary, counts binary").collect()
    langs = sorted(sizes)
    grams = np.zeros((len(langs), len(GRAMS), SIZE))
    scripts = np.zeros((len(langs), len(SCRIPTS) + 1))
    for lang, k, cells, counts in counted:
        to = scripts[langs.index(lang)] if k < 0 else grams[langs.index(lang), k]
        to[np.frombuffer(cells, np.int32)] += np.frombuffer(counts, np.int64)
    logs = np.log((grams + 0.5) / (grams.sum(axis=2, keepdims=True) + 0.5 * SIZE))
    logs -= logs.mean(axis=0, keepdims=True) if langs else 0
    known = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= 0.001
    known[:, ~known.any(axis=0)] = True
    return {"langs": langs, "tables": np.ascontiguousarray(logs.transpose(1, 2, 0).astype(np.float32)), "scripts": np.where(known.T, 0.0, FORBIDDEN).astype(np.float32)}


def word_scores(data: Batch, model: dict) -> np.ndarray:
    k = len(model["langs"])
    if not len(data.start):
        return np.zeros((0, k), np.float32)
    out = np.zeros((len(data.start), k), np.float32)
    for order, g, real in data.grams():
        each = model["tables"][order][g]
        each[~real] = 0
        out += np.add.reduceat(each, data.start - 1, axis=0)
    return out + model["scripts"][data.script]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word of each row (rows one after another) under a penalty for each change of label."""
    if not len(scores):
        return np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    n_at = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
    base = np.concatenate([[0], np.cumsum(n_at)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    t = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = base[t] + np.repeat(rank, lengths)
    timed = np.empty_like(scores)
    timed[place] = scores
    best = timed[: n_at[0]].copy()
    k = scores.shape[1]
    kind = np.min_scalar_type(k - 1)  # a byte a label up to 256 languages
    own = np.arange(k, dtype=kind)[None, :]
    back = np.zeros(scores.shape, kind)
    for step in range(1, len(n_at)):
        a, lo = n_at[step], base[step]
        v = best[:a]
        top = v.max(axis=1, keepdims=True)
        change = v < top - penalty
        back[lo : lo + a] = np.where(change, v.argmax(axis=1).astype(kind)[:, None], own)
        best[:a] = timed[lo : lo + a] + np.where(change, top - penalty, v)
    now = best.argmax(axis=1)
    label = np.zeros(len(scores), kind)
    for step in range(len(n_at) - 1, -1, -1):
        a, lo = n_at[step], base[step]
        label[lo : lo + a] = now[:a]
        if step:
            now[:a] = back[lo : lo + a][np.arange(a), now[:a]]
    return label[place].astype(np.int64)


def _has_letter(raw: np.ndarray) -> bool:
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def _predict(model, penalty: float, spans: bool, keep: bool):
    def run(batches):
        m = model.value
        langs, k = m["langs"], len(m["langs"])
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

        def label(batch, begun, rows, parts):
            keys = batch.column(0).slice(begun, rows - begun)
            data_letters = np.concatenate([p[0].letters for p in parts])
            lengths = np.concatenate([np.diff(p[0].first) for p in parts])
            real = np.concatenate([p[2] for p in parts])
            got = viterbi(np.concatenate([p[1] for p in parts]), lengths, penalty) if k else np.zeros(len(data_letters), np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            mass = np.bincount(row * max(k, 1) + got, weights=data_letters, minlength=len(lengths) * max(k, 1)).reshape(len(lengths), -1)
            top = mass.argmax(axis=1)
            score = mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1)
            known = real & (k > 0)
            out = [keys, pa.array([langs[i] if ok else "und" for i, ok in zip(top.tolist(), known.tolist(), strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))]
            names = ["id", "lang_pred", "score"]
            if spans:
                ends, runs = np.cumsum(lengths), []
                for r, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
                    g = got[e - n : e]
                    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if n and known[r] else np.zeros(0, np.int64)
                    runs.append([{"first": int(a), "words": int(b - a), "lang": langs[g[a]]} for a, b in zip(cut, np.append(cut[1:], n), strict=True)] if len(cut) else [])
                out.append(pa.array(runs, span_type))
                names.append("spans")
            if keep:
                out.append(batch.column(1).slice(begun, rows - begun))
                names.append("text")
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            parts, begun, held, rows = [], 0, 0, 0
            for _, raw, off in wk.slices([], batch.column(1)):
                data = Batch(raw, off)
                ascii_letter = np.concatenate([[0], np.cumsum((FOLD[raw] != 32) & (raw < 128))])
                real = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for r in np.flatnonzero(~real & (np.diff(off) > 0)).tolist():
                    real[r] = _has_letter(raw[off[r] : off[r + 1]])
                parts.append((data, word_scores(data, m) if k else np.zeros((len(data.start), 0), np.float32), real))
                data.text = data.letter = None
                held, rows = held + len(data.start), rows + len(off) - 1
                if held >= 1_000_000:
                    yield label(batch, begun, rows, parts)
                    parts, begun, held = [], rows, 0
            if parts:
                yield label(batch, begun, rows, parts)

    return wk.lean(run)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0, spans: bool = False, keep_text: bool = False) -> DataFrame:
    """(id, lang_pred, score), with ``spans`` also the labelled runs of words, for every row of docs; id_col may be a
    struct of columns that come along, and ``keep_text`` adds the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 0.8 MB a language
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    extra = (", spans array<struct<first: long, words: long, lang: string>>" if spans else "") + (", text string" if keep_text else "")
    return wk.over_texts(rows, _predict(shared, penalty, spans, keep_text), f"id {kind}, lang_pred string, score double{extra}").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: a quarter, by the CRC of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
