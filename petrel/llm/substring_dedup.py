"""Exact removal of word passages that an earlier document already has.

Method: fixed-block anchors.  Each text is cut into non-overlapping reference blocks of
``block`` words, aligned to its start; all rolling windows of as many words probe that
index.  A window of ``span`` words holds a whole reference block wherever it starts
(block = (span + 1) // 2), so a repeated passage has an anchor in it for sure.  Around
the anchors hits are extended to whole span windows, the earliest document of each is
found, and runs of covered windows make the maximal repeats, whose words go.

Hashes travel packed, dealt by hash into buckets whose number grows with the corpus; a
lost bucket is recomputed from its input alone.  Windows that are frequent among one task's
(``hot`` times, by default as the corpus' size asks) go to salted parts of their bucket, so no task gathers those of all texts.  Anchors are a filter without misses
(41 bits and more: a chance hit costs one comparison, no word); windows are compared by
57 bits and more.

Edge cases: null and empty texts have no words; texts shorter than ``span`` words keep
them all; of repeated rows with one id each is judged as one document of that id (an id's
own repeats are never removed); a null id counts as later than all others and is never
a reference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordkernel as wk
from .scratch import Scratch

KEY_BITS = 39
NO_ID = np.iinfo(np.int64).max


def _windows(raw, off, k):
    """Word hashes' windows of k words: (row, index of the row's first word, window hashes, rows' word bounds)."""
    start, end, first, w = wk.hashed_words(raw, off, wk.AS_IS)
    return start, end, first, w, wk.window_hashes(w, k)


def _inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows of k words that lie in one row, and their rows."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row], row


def _anchors(block: int, span: int, deal: wk.Deal, least: int):
    """Packed (hash, flag and key of the document) of every rolling window; the flag marks reference blocks."""

    def run(batches):
        parts, held = [], 0

        def flush():
            h, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            often = wk.hot(h, least)
            if often.any():
                # Frequent windows count as reference blocks; the first and the last document stand for them.
                x, y = h[often], o[often] | np.uint64(1 << KEY_BITS)
                yield deal.pack(x, [(x, 4), (y, 5)], wk.salt_of(y))
                stand = np.concatenate(wk.ends_of(x, y))
                h, o = np.concatenate([h[~often], x[stand]]), np.concatenate([o[~often], y[stand]])
            yield deal.pack(h, [(h, 4), (o, 5)])

        for batch in batches:
            for (keys,), raw, off in wk.slices([batch.column(0)], batch.column(1)):
                _, _, first, _, g = _windows(raw, off, block)
                at, row = _inside(first, block)
                long = np.diff(first)[row] >= span
                at, row = at[long], row[long]
                key = keys.to_numpy(zero_copy_only=False).astype(np.uint64)[row]
                flag = ((at - first[:-1][row]) % block == 0).astype(np.uint64) << np.uint64(KEY_BITS)
                parts.append((g[at], key | flag))
                held += len(at)
                if held >= wk.FLUSH:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    return wk.lean(run)


def _anchored(table: pa.Table) -> pa.Table:
    """The windows whose hash is a reference block's and occurs in two documents: rows (key, hash)."""
    b = np.uint64(table.column("bucket")[0].as_py())
    h, o = wk.unpack(table, [4, 5])
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(head, len(h)))
    key = o & np.uint64((1 << KEY_BITS) - 1)
    ref = np.maximum.reduceat(o >> np.uint64(KEY_BITS), head)
    two = np.maximum.reduceat(key, head) > np.minimum.reduceat(key, head)
    hit = np.repeat(two & (ref > 0), n)
    h, o = h[hit] | (b << np.uint64(32)), key[hit]
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return pa.table({"k": o[new].view(np.int64), "h": h[new].view(np.int64)})


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of an Arrow list column; a null is an empty list."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values, np.concatenate([[0], np.cumsum(lengths)]) if n else np.zeros(1, np.int64)


def _member(values: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Which values occur in the sets."""
    return np.isin(values, sets) if len(sets) and len(values) else np.zeros(len(values), bool)


def _extended(block: int, span: int, deal: wk.Deal, least: int):
    """Packed (hash, id) of every span window that holds an anchor."""

    def run(batches):
        parts, held = [], 0

        def flush():
            h, o = (np.concatenate(x) for x in zip(*parts, strict=True))
            often = wk.hot(h, least)
            if often.any():
                # All but the first document of a frequent window are later ones for sure; the first stands for them.
                x, y = h[often], o[often]
                yield deal.pack(x, [(x, 6), (y, 8)], wk.salt_of(y))
                stand = wk.ends_of(x, y.view(np.int64))[0]
                h, o = np.concatenate([h[~often], x[stand]]), np.concatenate([o[~often], y[stand]])
            yield deal.pack(h, [(h, 6), (o, 8)])

        for batch in batches:
            for (ids, hits), raw, off in wk.slices([batch.column(0), batch.column(2)], batch.column(1)):
                _, _, first, w, g = _windows(raw, off, block)
                g13 = wk.window_hashes(w, span)
                cut = ((g >> np.uint64(64 - deal.bits)) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
                values, bound = _lists(hits)
                id_list = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                for r in range(len(off) - 1):
                    a, b = int(first[r]), int(first[r + 1])
                    if b - a < span or bound[r + 1] == bound[r]:
                        continue
                    hit = np.concatenate([[0], np.cumsum(_member(cut[a : b - block + 1], values[bound[r] : bound[r + 1]]))])
                    reach = span - block + 1
                    some = hit[reach:] > hit[:-reach]
                    h = np.unique(g13[a : b - span + 1][some])
                    parts.append((h, np.full(len(h), id_list[r], np.int64).view(np.uint64)))
                    held += len(h)
                if held >= wk.FLUSH:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    return wk.lean(run)


def _later(table: pa.Table) -> pa.Table:
    """Windows of the documents other than a window's first: rows (id, hash)."""
    b = np.uint64(table.column("bucket")[0].as_py())
    h, o = wk.unpack(table, [6, 8])
    ids = o.view(np.int64)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    least = ids[np.flatnonzero(head)][np.cumsum(head) - 1]
    later = ids > least
    h, ids = h[later] | (b << np.uint64(48)), ids[later]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
    return pa.table({"id": ids[new], "h": h[new].view(np.int64)})


def covered_words(g13: np.ndarray, n: int, span: int, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Mask of the n words that a removed window covers."""
    out = np.zeros(n, bool)
    if n < span or not len(hashes):
        return out
    cut = ((g13 >> np.uint64(64 - bits)) << np.uint64(48)) | (g13 & np.uint64((1 << 48) - 1))
    at = np.flatnonzero(_member(cut, hashes))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + span, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(span: int, bits: int, full: bool):
    def run(batches):
        for batch in batches:
            for (ids, hashes, carried), raw, off in wk.slices([batch.column(0), batch.column(2), batch.column(3)], batch.column(1)):
                start, end, first, w, _ = _windows(raw, off, span)
                g13 = wk.window_hashes(w, span)
                values, bound = _lists(hashes)
                data = raw.tobytes()
                n_words, n_gone, shas, texts, spans = [], [], [], [], []
                for r in range(len(off) - 1):
                    a, b = int(first[r]), int(first[r + 1])
                    gone = covered_words(g13[a : max(a, b - span + 1)], b - a, span, bits, values[bound[r] : bound[r + 1]])
                    n_words.append(b - a)
                    n_gone.append(int(gone.sum()))
                    if full:
                        keep = np.repeat(True, int(off[r + 1] - off[r]))
                        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                        base, cuts = int(off[r]), []
                        for x, y in runs:
                            # From the first removed word to the start of the next kept one, or to the last one's end.
                            s, e = int(start[a + x]) - base, int(start[a + y] if a + y < b else end[a + y - 1]) - base
                            keep[s:e] = False
                            cuts.append({"first": x, "words": y - x})
                        texts.append(raw[off[r] : off[r + 1]][keep].tobytes().decode("utf-8", "replace") if cuts else data[off[r] : off[r + 1]].decode("utf-8", "replace"))
                        spans.append(cuts)
                    else:
                        if n_gone[-1]:
                            kept = np.flatnonzero(~gone) + a
                            joined = b" ".join([data[s:e] for s, e in zip(start[kept].tolist(), end[kept].tolist(), strict=True)])
                        else:
                            joined = b" ".join([data[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
                        shas.append(hashlib.sha256(joined).hexdigest())
                head = [ids, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64())]
                if full:
                    yield pa.RecordBatch.from_arrays([*head, pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), carried], names=["id", "n_words", "n_removed", "kept_text", "removed", "carried"])
                else:
                    yield pa.RecordBatch.from_arrays([*head, pa.array(shas, pa.string()), carried], names=["id", "n_words", "n_removed", "kept_sha256", "carried"])

    return wk.lean(run)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, span: int, scratch: Scratch, hot: int | None = None, coarse: int = wk.COARSE) -> tuple[DataFrame, int]:
    """(id, hashes): of each document the span windows that start in an earlier document, and the bits of a bucket."""
    block = (span + 1) // 2
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("k", F.expr(f"pmod(xxhash64(id), {1 << KEY_BITS}L)"))
    chars = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = wk.bucket_bits(chars / 6)
    deal, hot = wk.Deal(bits, coarse), hot or wk.hot_least(chars / 6)
    dealt = wk.over_texts(texts.select("k", "text"), _anchors(block, span, deal, hot), wk.PACKED)
    hits = deal.spread(dealt, [4, 5]).groupBy("bucket", "salt").applyInArrow(_anchored, "k long, h long")
    hits = scratch.save(hits, "anchors")
    del dealt
    scratch.release()
    mine = texts.join(hits.groupBy("k").agg(F.collect_list("h").alias("hits")), "k")
    dealt = wk.over_texts(mine.select("id", "text", "hits"), _extended(block, span, deal, hot), wk.PACKED)
    gone = scratch.save(deal.spread(dealt, [6, 8]).groupBy("bucket", "salt").applyInArrow(_later, "id long, h long"), "later")
    del dealt, mine, hits
    scratch.drop("anchors")
    scratch.release()
    return gone.groupBy("id").agg(F.collect_list("h").alias("hashes")), bits


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 13, full: bool = True, carry: list[str] | None = None, hot: int | None = None, coarse: int = wk.COARSE, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: id, n_words, n_removed, and with full the text without the removed words
    (the white space of what is left is kept) and their runs (first, words); else kept_sha256, the digest of
    the kept words joined by a space.  Columns named in carry come along."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    gone, bits = repeated_windows(docs, id_col, text_col, span, scratch, hot, coarse)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(True).alias("row"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    mine = texts.join(gone.withColumnRenamed("id", "of"), F.coalesce("id", F.lit(int(NO_ID))) == F.col("of"), "left").select("id", "text", "hashes", "carried")
    kind = "kept_text string, removed array<struct<first: long, words: long>>" if full else "kept_sha256 string"
    out = wk.over_texts(mine, _cut(span, bits, full), f"id long, n_words long, n_removed long, {kind}, carried {mine.schema['carried'].dataType.simpleString()}")
    return out.select(F.col("id").alias(id_col), *[c for c in out.columns if c not in ("id", "carried")], *[F.col(f"carried.{c}").alias(c) for c in carry or []])
