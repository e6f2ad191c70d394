"""Vectorised hashing of words and word windows over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
same as ``[^\\x20\\x09-\\x0D]+`` over code points.  Nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U = np.uint64
SLICE_BYTES = 500_000  # bytes of text hashed at once; a longer text is hashed alone


def lean(run: Callable) -> Callable:
    """A task function over Arrow batches that gives its memory back to the system when it ends: workers are reused."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc
            return

    return wrapped


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def over_texts(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches bounded by bytes: Spark bounds them by rows, and the JVM builds each batch
    outside its heap, doubling as it grows.  Sets BATCH for the session where nobody has."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
AS_IS = stream(11, 256)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] = AS_IS[ord("a") : ord("z") + 1]
COEF = stream(23, 64) | U(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, dtype=U)
        while len(out) < max(n, 1024):
            out = np.concatenate([out, out * U(pow(base, len(out), 1 << 64))])
        if len(out) > 8 * SLICE_BYTES:
            return out
        _POWERS[base] = have = out
    return have


def slices(keys: list[pa.Array], text: pa.Array) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Runs of rows of at most SLICE_BYTES of text: (keys, bytes, offsets); null texts are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    n = len(text)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, dtype=kind)[text.offset : text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, side="right")) - 1)
        yield [k.slice(at, to - at) for k in keys], raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    isw = ~SPACE[raw]
    first = isw.copy()
    first[1:] &= ~isw[:-1]
    cut = off[:-1][off[:-1] < len(raw)]
    first[cut] = isw[cut]
    last = isw.copy()
    last[:-1] &= ~isw[1:]
    cut = off[1:][off[1:] > 0] - 1
    last[cut] = isw[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(table[raw] * powers(BASE, len(raw))[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(raw))[start])


def hashed_words(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows' first words (as ``words``) and hashes; a row of many slices is hashed slice by slice, cut at
    white space, as hashing takes some forty bytes for each byte of text."""
    if len(raw) <= 4 * SLICE_BYTES:
        start, end, first = words(raw, off)
        return start, end, first, word_hashes(raw, start, end, table)
    cuts, at = [0], 0
    bounds = off[1:]
    while at < len(raw):
        to = min(len(raw), at + SLICE_BYTES)
        if to < len(raw):
            space = np.flatnonzero(SPACE[raw[to : to + SLICE_BYTES]])
            while not len(space) and to < len(raw):
                to = min(len(raw), to + SLICE_BYTES)
                space = np.flatnonzero(SPACE[raw[to : to + SLICE_BYTES]])
            to = to + int(space[0]) if len(space) else len(raw)
        cuts.append(to)
        at = to
    starts, ends, hashes = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        inner = bounds[(bounds > a) & (bounds < b)] - a
        start, end, _ = words(raw[a:b], np.concatenate([[0], inner, [b - a]]))
        hashes.append(word_hashes(raw[a:b], start, end, table))
        starts.append(start + a)
        ends.append(end + a)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.searchsorted(start, off), np.concatenate(hashes)


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, rows not regarded: entry i covers words i to i+k-1."""
    m = len(w) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = w[:m] * COEF[0]
    for j in range(1, k):
        out = out + w[j : j + m] * COEF[j]
    return mix(out)


def short_hash(w: np.ndarray) -> np.uint64:
    """Hash of a whole sequence that is shorter than a window."""
    with np.errstate(over="ignore"):
        return mix(np.array([(w * COEF[: len(w)]).sum(dtype=U) + U(len(w)) * U(0xD6E8FEB86659FD93)], dtype=U))[0]


# Packed rows: the hashes of many texts travel as a few binary rows, a bucket of the hash space each.

# An entry's hash chooses its bucket.  A hash that is frequent within one task's batch of entries (``hot``) is one that
# a large share of all texts may have: its entries go to a salted part of the bucket, another for each batch, and only
# a few that stand for them go to the bucket's plain part (salt 0), where they meet the other batches' entries.

HOT = 256
FLUSH = 400_000  # entries of a batch
PLAIN = 2_000_000  # entries of one hash that the plain part of a bucket may get
SALTS = 4095


def hot_least(entries: float) -> int:
    """From how many entries in a batch on a hash counts as frequent: HOT, or less in a large corpus, so that the batches'
    infrequent entries of one hash together are PLAIN at most (or two for each batch)."""
    return int(min(HOT, max(2, PLAIN * FLUSH // max(1, entries))))


def hot(h: np.ndarray, least: int) -> np.ndarray:
    """Which entries have a hash that occurs at least ``least`` times among them."""
    low = (h & U(0xFFFFF)).astype(np.int64)
    often = np.bincount(low, minlength=1 << 20)[low] >= least
    if often.any():
        at = np.flatnonzero(often)
        _, back, n = np.unique(h[at], return_inverse=True, return_counts=True)
        often[at] = n[back] >= least
    return often


def ends_of(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash the index of its entry with the least owner and of that with the greatest."""
    order = np.lexsort((owner, h))
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    return order[first], order[np.append(first[1:], len(order)) - 1]


def salt_of(owner: np.ndarray) -> int:
    """The salt of a batch of entries; a repeated task finds the same."""
    return 1 + int(mix(owner[:1])[0] % U(SALTS))


def pack(bucket: np.ndarray, buckets: int, fields: list[tuple[np.ndarray, int]], salt: int = 0, stand: bool = False) -> pa.RecordBatch:
    """One row (bucket, salt, stand, n, data) per bucket that has entries; data holds each field's low bytes as planes.

    ``stand`` marks entries that stand for those of a salted part.
    """
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    planes = []
    for values, width in fields:
        v = values[order].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        planes.append((np.ascontiguousarray(v[:, :width]), width))
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    data = [b"".join(p[ends[b] - counts[b] : ends[b]].tobytes() for p, _ in planes) for b in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), salt, np.int32)), pa.array(np.full(len(full), stand)), pa.array(counts[full].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "salt", "stand", "n", "data"])


PACKED = "bucket int, salt int, stand boolean, n int, data binary"


def unpack(table: pa.Table, widths: list[int]) -> list[np.ndarray]:
    """The fields of all rows of a table of packed rows."""
    n = table.column("n").to_numpy()
    out = [np.zeros((int(n.sum()), 8), np.uint8) for _ in widths]
    at = 0
    for rows, blob in zip(n.tolist(), table.column("data").to_pylist(), strict=True):
        raw, pos = np.frombuffer(blob, np.uint8), 0
        for o, width in zip(out, widths, strict=True):
            o[at : at + rows, :width] = raw[pos : pos + rows * width].reshape(rows, width)
            pos += rows * width
        at += rows
    return [o.view("<u8").reshape(-1) for o in out]


COARSE = 13


class Deal:
    """How entries are dealt to 2^bits buckets by the top bits of their hash.

    Of many buckets a batch would hold less than an entry each, so it is dealt to 2^coarse of them first, and a task that
    gathers a coarse bucket deals full batches of it on (``spread``).
    """

    def __init__(self, bits: int, coarse: int = COARSE):
        self.bits, self.coarse = bits, min(bits, coarse)
        self.fine = bits - self.coarse

    def pack(self, h: np.ndarray, fields: list[tuple[np.ndarray, int]], salt: int = 0, stand: bool = False) -> pa.RecordBatch:
        if self.fine:
            fields = [*fields, ((h >> U(64 - self.bits)) & U((1 << self.fine) - 1), 3)]
        return pack((h >> U(64 - self.coarse)).astype(np.int64), 1 << self.coarse, fields, salt, stand)

    def spread(self, dealt, widths: list[int]):
        """Packed rows by their final buckets."""
        if not self.fine:
            return dealt
        fine = self.fine

        def run(batches):
            key, rows, held = None, [], 0

            def flush():
                table = pa.table({"n": pa.array([n for n, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})
                *fields, middle = unpack(table, [*widths, 3])
                out = pack(middle.astype(np.int64), 1 << fine, list(zip(fields, widths, strict=True)), key[1], key[2])
                bucket = pa.array((out.column(0).to_numpy().astype(np.int64) + (key[0] << fine)).astype(np.int32))
                return pa.RecordBatch.from_arrays([bucket, *out.columns[1:]], names=out.schema.names)

            for batch in batches:
                for bucket, salt, stand, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if rows and ((bucket, salt, stand) != key or held >= FLUSH):
                        yield flush()
                        rows, held = [], 0
                    key = (bucket, salt, stand)
                    rows.append((n, data))
                    held += n
            if rows:
                yield flush()

        return dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "stand").mapInArrow(lean(run), PACKED)


def bucket_bits(entries: float, per_bucket: int = 1_000_000, least: int = 9) -> int:
    """Bits of the hash that choose a bucket, so that a bucket holds about per_bucket entries however many there are."""
    return max(least, int(np.ceil(np.log2(max(1.0, entries / per_bucket)))))
