"""SAS transport files, version 5 (XPT), as a data source.

    spark.read.format("xpt").option("member", "DM").load(path)

The driver reads headers and finds each member's range of observations; tasks decode runs
of whole observations to Arrow.  Options: ``member`` (name; the first one otherwise),
``columns`` (comma-separated, for pruning), ``encoding`` (ISO-8859-1), ``trim`` (true),
``missingTags`` (adds NAME__mv with a missing value's tag), ``blankFrame`` (``end``: an
all-blank observation ends the member, as the format's padding does; ``padding``: only
trailing ones do), ``oneMember`` (no further member follows: with ``padding`` the driver then
reads a file's head and tail only), ``partitionBytes`` (32 MB).  The format holds no counts,
so otherwise the driver reads the member's bytes once to find its end.  A folder's files must
have one layout.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..codecs import ibm
from ..codecs.cells import texts
from ..codecs.charsets import python_codec
from .files import Reader, flag, listed

RECORD = 80
TAG = b"HEADER RECORD*******"
MEMBER = TAG + b"MEMBER  HEADER RECORD!!!!!!!"
NAMESTR = struct.Struct(">hhhh8s40s8shhh2x8shhi52x")
SCAN = 8 << 20
_STAMP = re.compile(r"(\d{2})([A-Z]{3})(\d{2}|\d{4}):(\d{2}):(\d{2}):(\d{2})")
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


@dataclass
class Variable:
    name: str
    label: str
    numeric: bool
    length: int
    position: int
    number: int
    name_hash: int
    format: tuple[str, int, int, int]
    informat: tuple[str, int, int]


@dataclass
class Member:
    name: str
    label: str
    type: str
    version: str
    os: str
    created: str
    modified: str
    descriptor: int
    first: int
    end: int
    variables: list[Variable] = field(default_factory=list)

    @property
    def width(self) -> int:
        return max((v.position + v.length for v in self.variables), default=0)


@dataclass
class LibraryHeader:
    version: str
    os: str
    created: str
    modified: str
    members: list[Member]


def stamp(text: str, this_year: int | None = None) -> datetime | None:
    """A header's ddMMMyy:HH:mm:ss; two digits of a year mean one of the hundred that end with this year."""
    m = _STAMP.fullmatch(text.strip().upper())
    if m is None or m[2] not in _MONTHS:
        return None
    now = this_year or datetime.now().year
    year = int(m[3]) if len(m[3]) == 4 else now - (now - int(m[3])) % 100
    return datetime(year, _MONTHS.index(m[2]) + 1, int(m[1]), int(m[4]), int(m[5]), int(m[6]))


def _text(raw: bytes) -> str:
    return raw.decode("ascii", "replace").rstrip(" \0")


def _next_member(file: Reader, at: int) -> int:
    """Offset of the next member header at or after a record boundary, else the file's size."""
    while at < file.size:
        block = file.at(at, SCAN + RECORD)
        pos = block.find(MEMBER)
        while pos >= 0:
            if (at + pos) % RECORD == 0:
                return at + pos
            pos = block.find(MEMBER, pos + 1)
        at += SCAN
    return file.size


def parse_library(uri: str, until: str | None = None) -> LibraryHeader:
    """Headers of a transport file and where its members' observations are; with ``until`` only as far as the member
    of that name, or the first one for ``""``, whose own end is not looked for."""
    with Reader(uri) as file:
        head = file.at(0, 3 * RECORD)
        if not head.startswith(TAG + b"LIBRARY HEADER RECORD"):
            raise ValueError(f"{uri}: not a version 5 transport file")
        one, two = head[RECORD : 2 * RECORD], head[2 * RECORD :]
        lib = LibraryHeader(_text(one[24:32]), _text(one[32:40]), _text(one[64:80]), _text(two[:16]), [])
        at = 3 * RECORD
        while at < file.size and file.at(at, len(MEMBER)) == MEMBER:
            size = int(file.at(at + 74, 4))
            if size != 140:
                raise ValueError(f"{uri}: descriptors of {size} bytes are not supported")
            a, b = file.at(at + 2 * RECORD, RECORD), file.at(at + 3 * RECORD, RECORD)
            names = file.at(at + 4 * RECORD, RECORD)
            if not names.startswith(TAG + b"NAMESTR HEADER RECORD"):
                raise ValueError(f"{uri}: member without its variable header")
            count = int(names[54:58])
            raw = file.at(at + 5 * RECORD, count * size)
            start = at + 5 * RECORD + -(-count * size // RECORD) * RECORD
            if not file.at(start, RECORD).startswith(TAG + b"OBS     HEADER RECORD"):
                raise ValueError(f"{uri}: member {_text(a[8:16])} without its observation header")
            start += RECORD
            last = until is not None and until in ("", _text(a[8:16]))
            end = file.size if last else _next_member(file, start)
            member = Member(_text(a[8:16]), _text(b[32:72]), _text(b[72:80]), _text(a[24:32]), _text(a[32:40]), _text(a[64:80]), _text(b[:16]), size, start, end)
            for i in range(count):
                kind, nhash, length, number, name, label, fname, fl, fd, fj, iname, il, idec, pos = NAMESTR.unpack_from(raw, i * size)
                if kind not in (1, 2):
                    raise ValueError(f"Invalid variable type id: {kind}")
                member.variables.append(Variable(_text(name), _text(label), kind == 1, length, pos, number, nhash, (_text(fname), fl, fd, fj), (_text(iname), il, idec)))
            lib.members.append(member)
            if last:
                break
            at = end
        return lib


def observations(file: Reader, m: Member, blank_frame: str = "end", one_member: bool = False) -> int:
    """Number of a member's observations by the format's end rules, in one pass over its bytes.

    The member ends where an observation would begin with the whole 20-byte tag of a header record after nothing but
    blanks, wherever the tag lies; at an all-blank observation (or, with ``padding``, only where nothing but blanks
    follows); else with the file, of which a short rest must be blank.  With ``padding`` and ``one_member`` the file is
    known to hold no further header, and only its last observations are read.
    """
    width, size = m.width, file.size - m.first
    if not width:
        return 0
    whole, ended = size // width, False
    step = max(1, SCAN // width)
    for k in range(0, 0 if one_member and blank_frame == "padding" else -(-size // width), step):
        n = min(step, whole - k)
        raw = file.at(m.first + k * width, step * width + len(TAG) - 1)
        ends = []
        q = raw.find(TAG)
        while 0 <= q < step * width:
            if not raw[q // width * width : q].strip(b" "):
                ends.append(k + q // width)
                break
            q = raw.find(TAG, q + 1)
        tagged = bool(ends)
        if blank_frame == "end" and n > 0:
            frames = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
            blank = np.flatnonzero((frames[:, 0] == 32) & (frames == 32).all(axis=1))
            ends += [k + int(blank[0])] if len(blank) else []
        if ends:
            if blank_frame == "end" or not tagged:
                return min(ends)
            whole, ended = ends[0], True
            break
    if not ended and file.at(m.first + whole * width, size - whole * width).strip(b" "):
        raise ValueError("Truncated XPT file")
    if blank_frame == "padding":
        while whole and not file.at(m.first + (whole - 1) * width, width).strip(b" "):
            whole -= 1
    return whole


@dataclass
class Run(InputPartition):
    uri: str
    offset: int
    count: int


def decode_frames(raw: bytes, count: int, variables: list[Variable], width: int, names: list[str], encoding: str, trim: bool, tags: bool) -> pa.RecordBatch:
    frames = np.frombuffer(raw, np.uint8, count * width).reshape(count, width)
    by_name = {v.name: v for v in variables}
    arrays = []
    for name in names:
        of = name.removesuffix("__mv") if tags and name.endswith("__mv") and name not in by_name else name
        v = by_name[of]
        part = np.ascontiguousarray(frames[:, v.position : v.position + v.length])
        if not v.numeric:
            arrays.append(texts(part, encoding, trim))
            continue
        values, missing, lead = ibm.decode(part)
        if of is name or of == name:
            arrays.append(pa.array(values, pa.float64(), mask=missing))
        else:
            arrays.append(pa.array([chr(x) if gone else None for x, gone in zip(lead.tolist(), missing.tolist(), strict=True)], pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


class XptSource(DataSource):
    @classmethod
    def name(cls):
        return "xpt"

    def _files(self) -> list[str]:
        return listed(self.options["path"], ".xpt")

    def _member(self, uri: str) -> Member:
        wanted = self.options.get("member")
        lib = parse_library(uri, "" if wanted is None or flag(self.options, "firstMemberOnly") else wanted)
        found = [m for m in lib.members if wanted is None or m.name == wanted]
        if not found:
            raise ValueError(f"{uri}: no member {wanted!r}" if wanted else f"{uri}: no members")
        return found[0]

    def schema(self):
        files = self._files()
        if not files:
            raise FileNotFoundError(self.options["path"])
        fields = []
        wanted = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else None
        for v in self._member(files[0]).variables:
            meta = {"label": v.label, "length": v.length, "format": v.format[0], "position": v.position}
            fields.append(StructField(v.name, DoubleType() if v.numeric else StringType(), True, meta))
            if v.numeric and flag(self.options, "missingTags"):
                fields.append(StructField(f"{v.name}__mv", StringType(), True))
        if wanted:
            by_name = {f.name.lower(): f for f in fields}
            fields = [by_name[c.lower()] for c in wanted]
        return StructType(fields)

    def reader(self, schema):
        return XptReader(self, schema)


class XptReader(DataSourceReader):
    def __init__(self, source: XptSource, schema: StructType):
        o = source.options
        self.names = schema.names
        self.encoding, self.trim, self.tags = python_codec(o.get("encoding", "ISO-8859-1")), flag(o, "trim", True), flag(o, "missingTags")
        target = int(o.get("partitionBytes", 32 << 20))
        self.runs, self.variables = [], None
        for uri in source._files():
            m = source._member(uri)
            layout = [(v.name, v.numeric, v.length, v.position) for v in m.variables]
            if self.variables is not None and layout != [(v.name, v.numeric, v.length, v.position) for v in self.variables]:
                raise ValueError(f"{uri}: its variables differ from those of the first file")
            self.variables, self.width = m.variables, m.width
            with Reader(uri) as file:
                count = observations(file, m, o.get("blankFrame", "end"), flag(o, "oneMember"))
            step = max(1, target // max(1, m.width))
            self.runs += [Run(uri, m.first + k * m.width, min(step, count - k)) for k in range(0, count, step)]

    def partitions(self):
        return self.runs or [Run("", 0, 0)]

    def read(self, run: Run):
        if not run.count:
            return
        step = max(1, (4 << 20) // max(1, self.width))
        with Reader(run.uri) as file:
            for k in range(0, run.count, step):
                n = min(step, run.count - k)
                raw = file.at(run.offset + k * self.width, n * self.width)
                yield decode_frames(raw, n, self.variables, self.width, self.names, self.encoding, self.trim, self.tags)
