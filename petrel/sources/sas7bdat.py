"""SAS7BDAT files as a data source.

    spark.read.format("sas7bdat").load(path)

The driver reads the headers and the metadata pages; tasks decode runs of pages, each from
its own bytes, to Arrow.  Files of 32 and 64 bits, either byte order, uncompressed, RLE-
and RDC-compressed; rows marked deleted are left out.  Options: ``columns`` (for pruning),
``encoding`` (the file's own otherwise), ``missing`` (``nan``, or ``null``),
``includeDeleted`` (keeps deleted rows and adds _deleted), ``verify`` (declared against
read rows, per file), ``partitionBytes`` (32 MB).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..codecs.cells import texts
from ..codecs import rdc, rle
from ..codecs.charsets import charset_of, python_codec
from .files import Reader, flag, listed

MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
ALIGNED = 51
#: Page types by id, and what they hold.
PAGE_TYPES = {0: "META", 16384: "META2", 128: "CMETA", 256: "DATA", 384: "DATA2", 512: "MIXED1", 640: "MIXED2", 1024: "AMD", -28672: "COMP"}
METADATA = {"META", "META2", "CMETA", "MIXED1", "MIXED2", "AMD"}
BLOCKS = {"DATA", "DATA2", "MIXED1", "MIXED2"}
DELETABLE = {"DATA2", "MIXED2"}
#: Subheader signatures, as signed integers of 32 or 64 bits.
ROW_SIZE, COLUMN_SIZE, COUNTS, TEXT, NAMES, ATTRIBUTES, FORMAT, LIST = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFC00, 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC, 0xFFFFFBFE, 0xFFFFFFFE
KINDS = {ROW_SIZE, COLUMN_SIZE, COUNTS, TEXT, NAMES, ATTRIBUTES, FORMAT, LIST}
COMPRESSORS = {"SASYZCRL": rle.decompress, "SASYZCR2": rdc.decompress}
SAS_EPOCH = datetime(1960, 1, 1)


@dataclass
class Column:
    name: str
    label: str
    format: str
    offset: int
    width: int
    numeric: bool
    sort_order: int


@dataclass
class Header:
    uri: str
    little: bool
    wide: bool
    platform: str
    encoding: int
    name: str
    file_type: str
    created: datetime | None
    modified: datetime | None
    header_size: int
    page_size: int
    page_count: int
    release: str = ""
    server: str = ""
    os_version: str = ""
    os_vendor: str = ""
    os_name: str = ""
    row_length: int = 0
    row_count: int = 0
    deleted: int = 0
    column_count: int = 0
    mixed_rows: int = 0
    compression: str = ""
    label: str = ""
    creator: str = ""
    process: str = ""
    columns: list[Column] = field(default_factory=list)

    def unpack(self, code: str, raw: bytes, at: int):
        return struct.unpack_from(("<" if self.little else ">") + code, raw, at)[0]

    def integer(self, raw: bytes, at: int) -> int:
        return self.unpack("q" if self.wide else "i", raw, at)

    @property
    def charset(self) -> str:
        return charset_of(self.encoding) or "ISO-8859-1"


@dataclass
class Pointer:
    offset: int
    length: int
    compression: int
    category: int


@dataclass
class Page:
    kind: str | None
    blocks: int
    pointers: list[Pointer]
    deleted_at: int


def _moment(seconds: float) -> datetime | None:
    try:
        return SAS_EPOCH + timedelta(seconds=seconds)
    except (OverflowError, ValueError):
        return None


def parse_header(file: Reader, uri: str) -> Header:
    raw = file.at(0, 512)
    if raw[:32] != MAGIC:
        raise ValueError(f"{uri}: not a SAS7BDAT file")
    wide, pad, little = raw[32] == ALIGNED, 4 if raw[35] == ALIGNED else 0, raw[37] == 1
    h = Header(uri, little, wide, {"1": "UNIX", "2": "WINDOWS"}.get(chr(raw[39]), chr(raw[39])), raw[70], raw[92:156].rstrip(b" \0").decode("latin-1"), raw[156:164].rstrip(b" \0").decode("latin-1"), None, None, 0, 0, 0)
    if raw[84:92] != b"SAS FILE":
        raise ValueError(f"{uri}: damaged header")
    h.created, h.modified = _moment(h.unpack("d", raw, 164 + pad)), _moment(h.unpack("d", raw, 172 + pad))
    h.header_size, h.page_size = h.unpack("i", raw, 196 + pad), h.unpack("i", raw, 200 + pad)
    h.page_count = h.integer(raw, 204 + pad)
    at = 204 + pad + (8 if wide else 4) + 8
    parts = []
    for n in (8, 16, 16, 16, 16):
        parts.append(raw[at : at + n].rstrip(b" \0").decode("latin-1"))
        at += n
    h.release, h.server, h.os_version, h.os_vendor, h.os_name = parts
    return h


def parse_page(h: Header, raw: bytes) -> Page:
    """Type, row count, subheader pointers and deleted pointer of a page."""
    size = 40 if h.wide else 24
    kind = PAGE_TYPES.get(h.unpack("h", raw, size - 8))
    blocks, count = h.unpack("H", raw, size - 6), h.unpack("H", raw, size - 4)
    deleted_at = h.integer(raw, 24 if h.wide else 12)
    step, code = (24, 8) if h.wide else (12, 4)
    pointers = []
    if kind in METADATA:
        for i in range(count):
            at = size + i * step
            pointers.append(Pointer(h.integer(raw, at), h.integer(raw, at + code), raw[at + 2 * code], raw[at + 2 * code + 1]))
    return Page(kind, blocks, pointers, deleted_at)


def signature(h: Header, raw: bytes, at: int) -> int | None:
    """The kind of the subheader at an offset of a page, or None."""
    if h.wide:
        value = h.unpack("Q", raw, at)
        high, low = value >> 32, value & 0xFFFFFFFF
        for known in KINDS:
            if low == known and high in (0, 0xFFFFFFFF):
                return known
            if high == known and low in (0, 0xFFFFFBFE) and known in (ROW_SIZE, COLUMN_SIZE):
                return known
        return None
    value = h.unpack("I", raw, at)
    return value if value in KINDS else None


def is_row(h: Header, p: Pointer, kind: int | None) -> bool:
    """Whether a pointer of a compressed file holds a row."""
    return kind is None and bool(h.compression) and p.category == 1 and (p.compression == 4 or p.compression == 0 and p.length == h.row_length)


class _Metadata:
    def __init__(self, h: Header):
        self.h, self.texts, self.names, self.attributes, self.formats, self.slots = h, [], [], [], [], []

    def text(self, index: int, start: int, length: int) -> str:
        """A slice of a text subheader; offsets count from behind the signature."""
        if not length or index >= len(self.texts):
            return ""
        raw = self.texts[index][start : start + length].replace(b"\0", b" ").rstrip()
        return raw.decode(python_codec(self.h.charset), "replace")

    def take(self, kind: int, raw: bytes) -> None:
        h, n = self.h, 8 if self.h.wide else 4
        short = lambda at: h.unpack("H", raw, at)
        if kind == ROW_SIZE:
            h.row_length, h.row_count = h.integer(raw, 5 * n), h.integer(raw, 6 * n)
            h.deleted = h.integer(raw, 7 * n)
            h.column_count = h.integer(raw, 9 * n) + h.integer(raw, 10 * n)
            h.mixed_rows = h.integer(raw, 15 * n)
            # Text slots (index, offset, length) of label, software, compression and process.
            base = 678 if h.wide else 350
            self.slots = [(short(base + 6 * i), short(base + 6 * i + 2), short(base + 6 * i + 4)) for i in range(5)]
        elif kind == COLUMN_SIZE:
            self.declared = h.integer(raw, n)
        elif kind == TEXT:
            self.texts.append(raw[n:])
        elif kind == NAMES:
            for i in range((len(raw) - 2 * n - 12) // 8):
                at = n + 8 + 8 * i
                self.names.append((short(at), short(at + 2), short(at + 4), raw[at + 6]))
        elif kind == ATTRIBUTES:
            step = n + 8
            for i in range((len(raw) - 2 * n - 12) // step):
                at = n + 8 + step * i
                self.attributes.append((h.integer(raw, at), h.unpack("i", raw, at + n), raw[at + n + 6]))
        elif kind == FORMAT:
            at = 46 if h.wide else 34
            self.formats.append(tuple(short(at + 2 * i) for i in range(6)))

    def finish(self) -> None:
        h = self.h
        if getattr(self, "declared", h.column_count) != h.column_count:
            raise ValueError(f"{h.uri}: Column Count Mismatch")
        slots = [self.text(*s) for s in self.slots]
        h.label, h.creator, h.process = slots[0], slots[1], slots[4]
        for i, ((_, _, _, order), (offset, width, kind)) in enumerate(zip(self.names, self.attributes, strict=True)):
            if kind not in (1, 2):
                raise ValueError(f"Invalid variable type id: {kind}")
            f = self.formats[i] if i < len(self.formats) else (0,) * 6
            # The high bit marks a descending key; the rest is its place among the keys, 0 for none.
            sort = -(order & 0x7F) if order & 0x80 else order
            h.columns.append(Column(self.text(*self.names[i][:3]), self.text(*f[3:]), self.text(*f[:3]), offset, width, kind == 1, sort))
        if len(h.columns) != h.column_count:
            raise ValueError(f"{h.uri}: {len(h.columns)} columns described, {h.column_count} declared")


def parse_dataset(uri: str) -> Header:
    """Headers, columns and counts; pages are read until the columns are complete and rows begin."""
    with Reader(uri) as file:
        h = parse_header(file, uri)
        meta = _Metadata(h)
        for k in range(h.page_count):
            raw = file.at(h.header_size + k * h.page_size, h.page_size)
            page = parse_page(h, raw)
            complete = h.column_count and len(meta.names) >= h.column_count and len(meta.attributes) >= h.column_count
            if page.kind in ("DATA", "DATA2") and complete or page.kind is None:
                if complete:
                    break
                continue
            rows = 0
            for p in page.pointers:
                if p.compression == 1 or not p.length:
                    continue
                kind = signature(h, raw, p.offset)
                if is_row(h, p, kind):
                    rows += 1
                elif kind is not None:
                    meta.take(kind, raw[p.offset : p.offset + p.length])
                    if not h.compression and meta.slots and meta.texts:
                        name = meta.text(*meta.slots[2])
                        h.compression = name if name in COMPRESSORS else ""
            if rows and complete:
                break
        meta.finish()
        return h


def data_offset(h: Header, page: Page, raw: bytes) -> int:
    """Where a page's block of rows begins: behind the pointers, and behind four filler bytes if they are filler."""
    at = (40 if h.wide else 24) + (24 if h.wide else 12) * len(page.pointers)
    if at % 8 not in (0, 4):
        raise ValueError(f"unexpected alignment of rows: {at % 8}")
    if at % 8 == 4 and raw[at : at + 4] in (b"\0" * 4, b" " * 4):
        at += 4
    return at


def block_rows(h: Header, page: Page) -> int:
    if page.kind in ("MIXED1", "MIXED2"):
        return min(h.mixed_rows, h.row_count)
    return page.blocks if page.kind in BLOCKS else 0


def deleted_rows(h: Header, page: Page, raw: bytes, start: int, rows: int) -> np.ndarray:
    """Which rows of a page's block are deleted: a bitmap, highest bit first, behind the rows."""
    out = np.zeros(rows, bool)
    if page.kind in DELETABLE and page.deleted_at and rows:
        at = start + (page.blocks - len(page.pointers)) * h.row_length + page.deleted_at
        bits = np.unpackbits(np.frombuffer(raw[at : at + -(-rows // 8)], np.uint8), bitorder="big").astype(bool)
        out[: min(rows, len(bits))] = bits[:rows]
    return out


def page_rows(h: Header, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (n, row length) of a page's rows, those of subheaders first, and which are deleted."""
    page = parse_page(h, raw)
    parts, gone = [], []
    if page.kind is None:
        return np.zeros((0, h.row_length), np.uint8), np.zeros(0, bool)
    if h.compression:
        shrink = COMPRESSORS[h.compression]
        rows = []
        for p in page.pointers:
            if p.compression == 1 or not p.length or not is_row(h, p, signature(h, raw, p.offset)):
                continue
            row = raw[p.offset : p.offset + p.length]
            if p.length < h.row_length:
                row = shrink(row, h.row_length)
            elif p.length > h.row_length:
                raise ValueError(f"a row of {p.length} bytes, {h.row_length} expected")
            rows.append(row)
        if rows:
            parts.append(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, h.row_length))
            gone.append(np.zeros(len(rows), bool))
    n = block_rows(h, page)
    if n:
        start = data_offset(h, page, raw)
        if start + n * h.row_length > len(raw):
            raise ValueError("rows reach beyond their page")
        parts.append(np.frombuffer(raw, np.uint8, n * h.row_length, start).reshape(n, h.row_length))
        gone.append(deleted_rows(h, page, raw, start, n))
    if not parts:
        return np.zeros((0, h.row_length), np.uint8), np.zeros(0, bool)
    return np.concatenate(parts), np.concatenate(gone)


def decode_column(h: Header, c: Column, rows: np.ndarray, encoding: str, missing: str) -> pa.Array:
    cells = np.ascontiguousarray(rows[:, c.offset : c.offset + c.width])
    n = len(cells)
    if not c.numeric:
        return texts(cells, encoding)
    order = "<" if h.little else ">"
    if c.width == 1:
        values = (cells[:, 0] != 0).astype(np.float64) if n else np.zeros(0)
    elif c.width == 2:
        values = cells.view(f"{order}i2").reshape(-1).astype(np.float64)
    else:
        full = np.zeros((n, 8), np.uint8)
        # A short number lacks the low-order bytes of its mantissa.
        full[:, 8 - c.width :] = cells if h.little else 0
        if not h.little:
            full[:, : c.width] = cells
        values = full.view(f"{order}f8").reshape(-1).astype(np.float64)
    return pa.array(values, pa.float64(), mask=np.isnan(values) if missing == "null" else None)


@dataclass
class Pages(InputPartition):
    file: int
    first: int
    last: int


class Sas7bdatSource(DataSource):
    @classmethod
    def name(cls):
        return "sas7bdat"

    def _headers(self) -> list[Header]:
        files = listed(self.options["path"], ".sas7bdat")
        if not files:
            raise FileNotFoundError(self.options["path"])
        return [parse_dataset(f) for f in files]

    def schema(self):
        h = self._headers()[0]
        fields = [StructField(c.name, DoubleType() if c.numeric else StringType(), True, {"label": c.label, "format": c.format, "length": c.width, "sortOrder": c.sort_order}) for c in h.columns]
        if self.options.get("columns"):
            by_name = {f.name.lower(): f for f in fields}
            fields = [by_name[c.strip().lower()] for c in self.options["columns"].split(",")]
        if flag(self.options, "includeDeleted"):
            fields.append(StructField("_deleted", BooleanType(), False))
        return StructType(fields)

    def reader(self, schema):
        return Sas7bdatReader(self, schema)


class Sas7bdatReader(DataSourceReader):
    def __init__(self, source: Sas7bdatSource, schema: StructType):
        o = source.options
        self.names = schema.names
        self.headers = source._headers()
        first = [(c.name, c.numeric) for c in self.headers[0].columns]
        for h in self.headers:
            if [(c.name, c.numeric) for c in h.columns] != first:
                raise ValueError(f"{h.uri}: its columns differ from those of the first file")
        self.missing, self.keep = o.get("missing", "nan"), flag(o, "includeDeleted")
        self.encoding = python_codec(o["encoding"]) if o.get("encoding") else None
        self.target = int(o.get("partitionBytes", 32 << 20))
        if flag(o, "verify"):
            for h in self.headers:
                verify_rows(h)

    def partitions(self):
        out = []
        for i, h in enumerate(self.headers):
            step = max(1, self.target // h.page_size)
            out += [Pages(i, k, min(k + step, h.page_count)) for k in range(0, h.page_count, step)]
        return out

    def read(self, part: Pages):
        h = self.headers[part.file]
        encoding = self.encoding or python_codec(h.charset)
        by_name = {c.name: c for c in h.columns}
        with Reader(h.uri) as file:
            step = max(1, (2 << 20) // h.page_size)
            for k in range(part.first, part.last, step):
                n = min(step, part.last - k)
                raw = file.at(h.header_size + k * h.page_size, n * h.page_size)
                if len(raw) < n * h.page_size:
                    raise ValueError(f"{h.uri}: truncated, page {k + len(raw) // h.page_size} is not whole")
                found = [page_rows(h, raw[i * h.page_size : (i + 1) * h.page_size]) for i in range(n)]
                rows, gone = np.concatenate([r for r, _ in found]), np.concatenate([g for _, g in found])
                if not self.keep:
                    rows = rows[~gone]
                if len(rows):
                    arrays = [pa.array(gone) if name == "_deleted" and self.keep else decode_column(h, by_name[name], rows, encoding, self.missing) for name in self.names]
                    yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def verify_rows(h: Header) -> None:
    """Fail where the rows that a file holds are not those it declares."""
    rows = gone = 0
    with Reader(h.uri) as file:
        for k in range(h.page_count):
            _, g = page_rows(h, file.at(h.header_size + k * h.page_size, h.page_size))
            rows, gone = rows + len(g), gone + int(g.sum())
    if rows - gone != h.row_count - h.deleted:
        raise ValueError(f"{h.uri}: {h.row_count - h.deleted} rows declared, {rows - gone} read")
