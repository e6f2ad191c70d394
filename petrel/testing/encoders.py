"""Transport and SAS7BDAT files from arrays, for tests and for the round-trip queries."""

from __future__ import annotations

import struct

import numpy as np

from ..codecs import ibm


def pad(text: str | bytes, n: int) -> bytes:
    raw = text.encode() if isinstance(text, str) else text
    return raw[:n].ljust(n, b" ")


def char_cells(values, width: int) -> np.ndarray:
    """(n, width) bytes of texts, blank-padded."""
    out = np.full((len(values), width), 32, np.uint8)
    for i, v in enumerate(values):
        raw = (v or "").encode()[:width]
        out[i, : len(raw)] = list(raw)
    return out


def xpt_member(name: str, columns: list[tuple[str, np.ndarray, bool]], label: str = "", created: str = "01JAN20:00:00:00", labels: dict | None = None) -> bytes:
    """A member: columns of (name, cells (n, width), numeric), numeric cells being IBM floats."""
    tag = b"HEADER RECORD*******"
    zeros = b"0" * 30 + b"  "
    out = tag + b"MEMBER  HEADER RECORD!!!!!!!" + b"0" * 17 + b"1600000000140  "
    out += tag + b"DSCRPTR HEADER RECORD!!!!!!!" + zeros
    out += b"SAS     " + pad(name, 8) + b"SASDATA " + pad("9.4", 8) + pad("Linux", 8) + b" " * 24 + pad(created, 16)
    out += pad(created, 16) + b" " * 16 + pad(label, 40) + pad("", 8)
    out += tag + b"NAMESTR HEADER RECORD!!!!!!!000000" + b"%04d" % len(columns) + b"0" * 20 + b"  "
    names, at = b"", 0
    for i, (col, cells, numeric) in enumerate(columns):
        width = cells.shape[1]
        names += struct.pack(">hhhh8s40s8shhh2s8shhi52s", 1 if numeric else 2, 0, width, i + 1, pad(col, 8), pad((labels or {}).get(col, col), 40), pad("", 8), 0, 0, 0, b"\0\0", pad("", 8), 0, 0, at, b"\0" * 52)
        at += width
    out += names + b" " * (-len(names) % 80)
    out += tag + b"OBS     HEADER RECORD!!!!!!!" + zeros
    body = np.concatenate([c for _, c, _ in columns], axis=1).tobytes()
    return out + body + b" " * (-len(body) % 80)


def xpt_file(members: list[bytes], created: str = "01JAN20:00:00:00") -> bytes:
    out = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!" + b"0" * 30 + b"  "
    out += b"SAS     " * 2 + b"SASLIB  " + pad("9.4", 8) + pad("Linux", 8) + b" " * 24 + pad(created, 16) + pad(created, 80)
    return out + b"".join(members)


def numeric_cells(values) -> np.ndarray:
    return ibm.encode(np.asarray(values, dtype=np.float64))


def rle_compress(row: bytes) -> bytes:
    """Runs and literals; enough kinds of control bytes to exercise a reader."""
    out, i = bytearray(), 0
    literal = bytearray()

    def flush():
        at = 0
        while at < len(literal):
            left = len(literal) - at
            if left <= 64:
                n = left
                out.append(0x80 + 16 * ((n - 1) // 16) + (n - 1) % 16)
            else:
                n = min(left, 64 + 4095)
                out.extend(((n - 64) // 256, (n - 64) % 256))
            out.extend(literal[at : at + n])
            at += n
        literal.clear()

    while i < len(row):
        j = i
        while j < len(row) and row[j] == row[i] and j - i < 4000:
            j += 1
        n, byte = j - i, row[i]
        fill = {0x40: 0, 0x20: 1, 0x00: 2}.get(byte)
        if fill is not None and n >= 2:
            flush()
            if n < 18:
                out.append((0xD0 + 16 * fill) + n - 2)
            else:
                out.extend((0x50 + 16 * fill + (n - 17) // 256, (n - 17) % 256))
        elif n >= 3:
            flush()
            if n < 19:
                out.extend((0xC0 + n - 3, byte))
            else:
                out.extend((0x40 + (n - 18) // 256, (n - 18) % 256, byte))
        else:
            literal += row[i:j]
        i = j
    flush()
    return bytes(out)


def rdc_compress(row: bytes) -> bytes:
    """Runs and back references under 16-bit control words."""
    out, items, i = bytearray(), [], 0
    while i < len(row):
        j = i
        while j < len(row) and row[j] == row[i] and j - i < 4000:
            j += 1
        n = j - i
        if n >= 3:
            items.append((1, bytes((n - 3, row[i]))) if n < 19 else (1, bytes((0x10 + ((n - 19) & 15), (n - 19) >> 4, row[i]))) if n - 19 < 4096 else None)
            i = j
            continue
        best = 0
        for back in range(3, min(i, 4000) + 1):
            m = 0
            while m < 15 and i + m < len(row) and row[i + m] == row[i + m - back]:
                m += 1
            if m > best:
                best, where = m, back
            if best >= 12:
                break
        if best >= 3:
            items.append((1, bytes(((best << 4) | ((where - 3) & 15), (where - 3) >> 4))))
            i += best
        else:
            items.append((0, row[i : i + 1]))
            i += 1
    for k in range(0, len(items), 16):
        group = items[k : k + 16]
        word = sum(flag << (15 - x) for x, (flag, _) in enumerate(group))
        out += word.to_bytes(2, "big") + b"".join(b for _, b in group)
    return bytes(out)


MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")


def sas7bdat_file(columns: list[dict], cells: list[np.ndarray], name: str = "DATA", wide: bool = True, little: bool = True, compression: str = "", deleted: np.ndarray | None = None, page_size: int = 16384, created: float = 0.0, encoding: int = 20, label: str = "") -> bytes:
    """A file of columns (name, numeric, label, format, sort) and their cells (n, width).

    Compressed files leave deleted rows out and count them, uncompressed ones mark them in bitmaps.
    """
    e, n_int = "<" if little else ">", 8 if wide else 4
    code = "q" if wide else "i"
    rows = np.concatenate(cells, axis=1)
    gone = np.zeros(len(rows), bool) if deleted is None else deleted
    length, count = rows.shape[1], len(rows)
    p = lambda fmt, *v: struct.pack(e + fmt, *v)
    text = bytearray(p("H", 0) + b"\0" * 6 + b"\0" * 8)

    def slot(s: str) -> tuple[int, int, int]:
        if not s:
            return 0, 0, 0
        at, raw = len(text), s.encode()
        text.extend(raw + b" " * (-len(raw) % 4))
        return 0, at, len(raw)

    method = slot(compression)
    title, software, process = slot(label), slot("FIXTURE"), slot("WRITER")
    names = [slot(c["name"]) for c in columns]
    labels = [slot(c.get("label", "")) for c in columns]
    formats = [slot(c.get("format", "")) for c in columns]
    text[:2] = p("H", len(text))

    def sign(v: int) -> bytes:
        if wide:
            return p("Q", v if v in (0xF7F7F7F7, 0xF6F6F6F6) else v | 0xFFFFFFFF00000000)
        return p("I", v)

    row_size = bytearray(808 if wide else 480)
    row_size[:n_int] = sign(0xF7F7F7F7)
    for i, v in ((5, length), (6, count), (7, int(gone.sum())), (9, len(columns)), (10, 0), (13, page_size), (15, 0)):
        row_size[i * n_int : (i + 1) * n_int] = p(code, v)
    base = 678 if wide else 350
    for i, s in ((0, title), (1, software), (2, method), (4, process)):
        row_size[base + 6 * i : base + 6 * i + 6] = p("HHH", *s)
    subs = [(bytes(row_size), 0), (sign(0xF6F6F6F6) + p(code, len(columns)) + b"\0" * n_int, 0), (sign(0xFFFFFFFD) + bytes(text), 1)]
    subs.append((sign(0xFFFFFFFF) + p("Hhhh", 0, 0, 0, 0) + b"".join(p("HHHBB", *s, c.get("sort", 0), 0) for s, c in zip(names, columns, strict=True)) + b"\0" * (n_int + 4), 1))
    at, attributes = 0, b""
    for c, x in zip(columns, cells, strict=True):
        attributes += p(code + "iHBB", at, x.shape[1], 1, 1 if c["numeric"] else 2, 0)
        at += x.shape[1]
    subs.append((sign(0xFFFFFFFC) + p("Hhhh", 0, 0, 0, 0) + attributes + b"\0" * (n_int + 4), 1))
    for f, s in zip(formats, labels, strict=True):
        subs.append((sign(0xFFFFFBFE) + b"\0" * (38 if wide else 30) + p("HHH", *f) + p("HHH", *s) + b"\0" * 6, 0))

    head = 40 if wide else 24
    step = 24 if wide else 12

    def header(kind: int, blocks: int, n: int, deleted_at: int = 0) -> bytes:
        if wide:
            return b"\0" * 24 + p("q", deleted_at) + p("hHHH", kind, blocks, n, 0)
        return b"\0" * 12 + p("i", deleted_at) + p("hHHH", kind, blocks, n, 0)

    def pointer_page(parts: list[tuple[bytes, int, int]], kind: int = 0) -> bytes:
        page = bytearray(page_size)
        page[:head] = header(kind, len(parts), len(parts))
        end = page_size
        for i, (raw, packed, category) in enumerate(parts):
            end -= len(raw) + (-len(raw) % 8)
            page[end : end + len(raw)] = raw
            where = head + i * step
            page[where : where + step] = p(code * 2, end, len(raw)) + bytes((packed, category)) + b"\0" * (step - 2 * n_int - 2)
        if head + len(parts) * step > end:
            raise ValueError("page is too small")
        return bytes(page)

    def packed_pages(items):
        group, used = [], head
        for raw, packed, category in items:
            size = len(raw) + (-len(raw) % 8) + step
            if group and used + size > page_size - 64:
                yield pointer_page(group)
                group, used = [], head
            group.append((raw, packed, category))
            used += size
        if group:
            yield pointer_page(group)

    pages = list(packed_pages([(raw, 0, category) for raw, category in subs]))
    if compression:
        shrink = {"SASYZCRL": rle_compress, "SASYZCR2": rdc_compress}[compression]
        items = []
        for row in rows[~gone]:
            raw = row.tobytes()
            small = shrink(raw)
            items.append((small, 4, 1) if len(small) < length else (raw, 0, 1))
        pages += packed_pages(items)
    else:
        start = head + (-head % 8)
        marked = bool(gone.any())
        per = (page_size - start - 16) // length
        per = (page_size - start - 16 - per // 8) // length if marked else per
        for k in range(0, count, per):
            part = rows[k : k + per]
            page = bytearray(page_size)
            page[:head] = header(384 if marked else 256, len(part), 0, 8 if marked else 0)
            page[start : start + part.size] = part.tobytes()
            if marked:
                bits = np.packbits(gone[k : k + per], bitorder="big").tobytes()
                at = start + part.size + 8
                page[at : at + len(bits)] = bits
            pages.append(bytes(page))
    pad2 = 4 if wide else 0
    first = bytearray(1024)
    first[:32] = MAGIC
    first[32], first[35], first[37], first[39], first[70] = (51 if wide else 34), (51 if pad2 else 50), int(little), ord("1"), encoding
    first[84:92] = b"SAS FILE"
    first[92:156], first[156:164] = name.encode().ljust(64), b"DATA    "
    first[164 + pad2 : 172 + pad2], first[172 + pad2 : 180 + pad2] = p("d", created), p("d", created)
    first[196 + pad2 : 204 + pad2] = p("ii", 1024, page_size)
    first[204 + pad2 : 204 + pad2 + n_int] = p(code, len(pages))
    at = 204 + pad2 + n_int + 8
    for raw, n in ((b"9.0401M6", 8), (b"Linux", 16), (b"4.4", 16), (b"", 16), (b"x86_64", 16)):
        first[at : at + n] = raw.ljust(n, b"\0")
        at += n
    return bytes(first) + b"".join(pages)


def float_cells(values, little: bool = True, width: int = 8) -> np.ndarray:
    """IEEE doubles, the low-order bytes of the mantissa cut off for short widths."""
    raw = np.asarray(values, dtype="<f8" if little else ">f8").view(np.uint8).reshape(-1, 8)
    return raw[:, 8 - width :] if little else raw[:, :width]
