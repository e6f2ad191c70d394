"""CDISC Dataset-JSON: nested JSON, newline-delimited rows, gzip and zlib containers.

The driver reads a file's head (the metadata object) and nothing more.  Plain NDJSON rows
are split and read by Spark's text source and parsed by Catalyst expressions; compressed
files and rows nested in the metadata object, which cannot be split, are streamed by one
task each.  Rows that break the format fail the query when they are read.
"""

from __future__ import annotations

import json
import logging
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import mapping
from ..functions.buffers import buffer_type
from .files import Reader, listed, resolve

LOG = logging.getLogger(__name__)
SLICE_ROWS = 1000
CHUNK = 1 << 18
HEADS_AT_ONCE = 16
END_MARK = "end of the row"
REQUIRED = ("datasetJSONCreationDateTime", "datasetJSONVersion", "itemGroupOID", "name", "label")


@dataclass
class DsjColumn:
    index: int
    item_oid: str
    name: str
    label: str
    data_type: str
    target_type: str | None = None
    display_format: str | None = None
    length: int = -1
    key_sequence: int = -1


@dataclass
class DsjTable:
    path: str
    container: str
    nested: bool
    rows_at: int
    creation: str
    version: str
    item_group_oid: str
    name: str
    label: str
    records: int
    columns: list[DsjColumn]
    source_system: dict | None = None
    optional: dict = field(default_factory=dict)

    def schema(self) -> StructType:
        kinds = {"double": DoubleType(), "string": StringType()}
        return StructType([StructField(c.name, kinds[buffer_type(c.data_type)], True, {"label": c.label, "itemOID": c.item_oid, "dataType": c.data_type, "keySequence": c.key_sequence}) for c in self.columns])


def sniff(head: bytes) -> str:
    """PLAIN, GZIP or ZLIB by the first two bytes; the file's name has no say."""
    if len(head) < 2:
        raise OSError("too short to be a Dataset-JSON file")
    if head[:2] == b"\x1f\x8b":
        return "GZIP"
    if head[0] == 0x78:
        return "ZLIB"
    if head[0] == 0x7B:
        return "PLAIN"
    raise OSError(f"not Dataset-JSON: first bytes {head[:2].hex()}")


def text_chunks(uri: str, container: str):
    """A file's bytes in pieces, decompressed."""
    system, path = resolve(uri)
    with system.open_input_stream(path, compression=None) as stream:
        z = zlib.decompressobj(31 if container == "GZIP" else 15) if container != "PLAIN" else None
        while piece := stream.read(CHUNK):
            while piece:
                out = z.decompress(piece) if z else piece
                if out:
                    yield out
                if z and z.eof and z.unused_data:
                    piece, z = z.unused_data, zlib.decompressobj(31 if container == "GZIP" else 15)
                else:
                    break
        if z and not z.eof:
            raise OSError(f"{uri}: compressed data ends early")


def _refuse(token: str):
    raise ValueError(f"{token} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)


class Tokens:
    """Values one after another out of a text that arrives in pieces."""

    def __init__(self, chunks):
        self.chunks, self.raw, self.pos, self.taken, self.done = chunks, "", 0, 0, False
        self.pending = b""

    def more(self) -> bool:
        if self.done:
            return False
        for piece in self.chunks:
            data = self.pending + piece
            cut = len(data)
            for back in range(1, min(4, len(data)) + 1):  # do not cut a character
                if data[-back] >= 0xC0:
                    cut = len(data) - back if back < (2 if data[-back] < 0xE0 else 3 if data[-back] < 0xF0 else 4) else len(data)
                    break
                if data[-back] < 0x80:
                    break
            self.pending = data[cut:]
            self.taken += len(self.raw[: self.pos].encode())
            self.raw, self.pos = self.raw[self.pos :] + data[:cut].decode(), 0
            return True
        self.done = True
        return False

    def peek(self) -> str:
        """The next character that is no white space, or '' at the end."""
        while True:
            while self.pos < len(self.raw) and self.raw[self.pos] in " \t\r\n":
                self.pos += 1
            if self.pos < len(self.raw):
                return self.raw[self.pos]
            if not self.more():
                return ""

    def take(self, char: str) -> None:
        if self.peek() != char:
            raise ValueError(f"{char!r} expected, found {self.peek()!r}")
        self.pos += 1

    def value(self):
        """Decode the next value; more text is fetched while it may go on."""
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.raw, self.pos)
                if end < len(self.raw) or not self.more():
                    self.pos = end
                    return found
            except json.JSONDecodeError:
                if not self.more():
                    raise ValueError("damaged or truncated JSON") from None

    def slice(self) -> str:
        """The text of the next value."""
        self.peek()
        while True:
            try:
                _, end = _DECODER.raw_decode(self.raw, self.pos)
                if end < len(self.raw) or not self.more():
                    out, self.pos = self.raw[self.pos : end], end
                    return out
            except json.JSONDecodeError:
                if not self.more():
                    raise ValueError("damaged or truncated JSON") from None

    def offset(self) -> int:
        """Bytes before the next character."""
        return self.taken + len(self.raw[: self.pos].encode())


def _members(tokens: Tokens):
    """Members of the metadata object up to its end or to its rows: yields (name, value), then ('', nested)."""
    tokens.take("{")
    if tokens.peek() == "}":
        tokens.take("}")
        yield "", False
        return
    while True:
        name = tokens.value()
        tokens.take(":")
        if name == "rows":
            if tokens.peek() != "[":
                raise ValueError("rows must be an array")
            yield "", True
            return
        yield name, tokens.value()
        if tokens.peek() == "}":
            tokens.take("}")
            yield "", False
            return
        tokens.take(",")


def _whole(value, name: str, bits: int, default: int = -1) -> int:
    if not isinstance(value, int) or isinstance(value, bool):
        return default
    if not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise ValueError(f"{name} {value} does not fit {bits} bits")
    return value


def _columns(found) -> list[DsjColumn]:
    if not isinstance(found, list):
        raise ValueError("columns must be an array")
    out = []
    for i, c in enumerate(found):
        for key in ("itemOID", "name", "label", "dataType"):
            if not isinstance(c, dict) or c.get(key) is None:
                raise ValueError(f"column {i}: missing {key}")
        out.append(DsjColumn(i, c["itemOID"], c["name"], c["label"], mapping.parse_type(c["dataType"]), c.get("targetDataType"), c.get("displayFormat"), _whole(c.get("length"), "length", 32), _whole(c.get("keySequence"), "keySequence", 32)))
    return out


def read_head(path: str) -> DsjTable:
    """Metadata of a file, read from its head; where its rows begin."""
    with Reader(path) as file:
        container = sniff(file.at(0, 2))
    tokens = Tokens(text_chunks(path, container))
    meta, nested = {}, False
    for name, value in _members(tokens):
        if name:
            meta[name] = value  # of a repeated member the last one holds
        else:
            nested = value
    rows_at = tokens.offset()
    has_rows = nested or tokens.peek() == "["
    if "columns" not in meta:
        if has_rows:
            raise ValueError(f"{path}: columns must come before the rows")
        raise ValueError(f"{path}: missing columns")
    for key in REQUIRED:
        if meta.get(key) is None:
            raise ValueError(f"{path}: missing {key}")
    system = meta.get("sourceSystem")
    if isinstance(system, dict):
        for key in ("name", "version"):
            if system.get(key) is None:
                raise ValueError(f"{path}: sourceSystem without {key}")
    else:
        system = None
    optional = {k: meta.get(k) for k in ("dbLastModifiedDateTime", "fileOID", "metaDataRef", "metaDataVersionOID", "originator", "studyOID")}
    return DsjTable(path, container, nested, rows_at, meta["datasetJSONCreationDateTime"], meta["datasetJSONVersion"], meta["itemGroupOID"], meta["name"], meta["label"], _whole(meta.get("records"), "records", 64), _columns(meta["columns"]), system, optional)


def _stream_rows(container: str, nested: bool):
    """(value, row_index) of each row of whole files."""

    def rows(uri: str):
        tokens = Tokens(text_chunks(uri, container))
        found_nested = False
        for name, value in _members(tokens):
            found_nested = found_nested or (not name and value)
        if found_nested:
            tokens.take("[")
            if tokens.peek() == "]":
                tokens.take("]")
            else:
                while True:
                    yield tokens.slice()
                    if tokens.peek() == "]":
                        tokens.take("]")
                        break
                    tokens.take(",")
            while tokens.peek() == ",":
                tokens.take(",")
                if tokens.value() == "rows":
                    raise ValueError("Rows already parsed")
                tokens.take(":")
                tokens.value()
                LOG.warning("members after rows are ignored")
            tokens.take("}")
        while tokens.peek():
            if found_nested:
                raise ValueError("Rows already parsed")
            if tokens.peek() != "[":
                raise ValueError("a row must be an array")
            yield tokens.slice()

    def batch_of(held: list[str], first: int, uri: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(range(first, first + len(held)), pa.int64()), pa.array([_name(uri)] * len(held))], names=["value", "row_index", "file"])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, first = [], 0
                for row in rows(uri):
                    held.append(row)
                    if len(held) == 1024:
                        yield batch_of(held, first, uri)
                        first, held = first + len(held), []
                if held:
                    yield batch_of(held, first, uri)

    return run


def cells(value: Column, n: int, where: Column) -> Column:
    """Array of the texts of a row's n cells; a row that is no array of n values fails the query."""
    # Text behind a row's end would be passed over; between a bracket and one more element it shows.
    wrapped = F.from_json(F.concat(F.lit("["), value, F.lit(f',["{END_MARK}"]]')), "array<array<string>>")
    whole = (F.size(wrapped) == 2) & (F.get(F.get(wrapped, 1), 0) == END_MARK) & F.ltrim(value).startswith("[")
    parsed = F.when(whole, F.get(wrapped, 0))
    size = F.size(parsed)
    return (
        F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not a row: "), F.substring(value, 1, 80))).cast("array<string>"))
        .when(size != n, F.raise_error(F.concat(F.lit("row "), where, F.lit(" has "), size.cast("string"), F.lit(f" values, {n} expected"))).cast("array<string>"))
        .otherwise(parsed)
    )


def typed(cell: Column, kind: Column, data_type: str, name: str) -> Column:
    """A cell's text as its buffer holds it; a text or a truth value in a numeric column fails the query."""
    if buffer_type(data_type) != "double":
        return cell
    bad = cell.isNotNull() & ~F.coalesce(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"Invalid value in {name}: "), cell)).cast("double")).otherwise(cell.try_cast("double"))


def read_dsj(spark: SparkSession, path: str, verify: bool = True, row_index: bool = False, apply_targets: bool = False, strict: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The rows of a Dataset-JSON file, or of the files of a folder with one layout.

    ``verify`` counts the rows of all files against their declared numbers first, in one job; ``row_index`` adds the
    0-based _row_index in file order; ``apply_targets`` turns columns with a target type into
    numbers; ``strict`` refuses quoted numbers in numeric columns; ``columns`` prunes.
    """
    tables = read_heads(path)
    if not tables:
        raise FileNotFoundError(path)
    first = tables[0]
    for t in tables[1:]:
        if [(c.name, c.data_type) for c in t.columns] != [(c.name, c.data_type) for c in first.columns]:
            raise ValueError(f"{t.path}: its columns differ from those of {first.path}")
    rows = _raw_rows(spark, tables, row_index)
    n = len(first.columns)
    rows = rows.select(cells(F.col("value"), n, F.coalesce(F.col("row_index").cast("string"), F.lit("?"))).alias("cells"), "value", "row_index")
    wanted = [c for c in first.columns if columns is None or c.name in columns]
    if strict and any(buffer_type(c.data_type) == "double" for c in wanted):
        # One parse a row tells the kinds of all its numeric cells.
        rows = rows.select("cells", F.try_parse_json("value").alias("kinds"), "row_index")
    out = []
    for c in wanted:
        cell = F.col("cells")[c.index]
        kind = F.schema_of_variant(F.try_variant_get(F.col("kinds"), f"$[{c.index}]", "variant")) if strict and buffer_type(c.data_type) == "double" else F.lit("DOUBLE")
        x = typed(cell, kind, c.data_type, c.name)
        if apply_targets and mapping.parse_type(c.target_type, mapping.TARGET_TYPES) in ("integer", "decimal"):
            x = mapping.target_mapper(c.data_type, c.target_type)(x.cast("string") if buffer_type(c.data_type) == "double" else x)
        out.append(x.alias(c.name, metadata={"label": c.label, "itemOID": c.item_oid, "dataType": c.data_type, "keySequence": c.key_sequence}))
    result = rows.select(*out, *([F.col("row_index").alias("_row_index")] if row_index else []))
    if verify:
        verify_records(spark, tables)
    return result


def read_heads(path: str) -> list[DsjTable]:
    """The heads of a file, of a folder's files or of a pattern's, several at a time."""
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        return list(pool.map(read_head, listed(path, "json")))


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _raw_rows(spark: SparkSession, tables: list[DsjTable], row_index: bool) -> DataFrame:
    """(value, row_index, file): the text of each row; row_index is null for split files unless asked for.

    One branch for all plain files and one for each kind of the others, however many files there are."""
    plain = [t for t in tables if t.container == "PLAIN" and not t.nested]
    parts = [_ndjson_rows(spark, plain, row_index)] if plain else []
    for key in sorted({(t.container, t.nested) for t in tables if t.container != "PLAIN" or t.nested}):
        paths = [t.path for t in tables if (t.container, t.nested) == key]
        files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
        parts.append(files.mapInArrow(_stream_rows(*key), "value string, row_index long, file string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _head_lines(t: DsjTable) -> tuple[str, int, str]:
    """(file, line feeds of the metadata object, its first line); what follows on its last line must be blank."""
    with Reader(t.path) as file:
        raw = file.at(0, t.rows_at)
        rest = file.at(t.rows_at, CHUNK)
    line, feed, _ = rest.partition(b"\n")
    if line.strip():
        raise ValueError(f"{t.path}: a row on the metadata's last line")
    text = raw.rstrip(b" \t\r\n")
    return _name(t.path), raw.count(b"\n") + (1 if feed else 0), text.decode() if b"\n" not in text else ""


def _ndjson_rows(spark: SparkSession, tables: list[DsjTable], row_index: bool) -> DataFrame:
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        found = list(pool.map(_head_lines, tables))
    lines = spark.read.text([t.path for t in tables])
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # as in a URI
    file, block, place = name, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    blank = F.trim(F.regexp_replace("value", r"[\t\r]", "")) == ""
    if not row_index and all(head for _, _, head in found):
        rows = lines.select("value", file.alias("file"), block.alias("block")).where(~blank)
        if len(found) == 1:
            rows = rows.where(~((F.col("block") == 0) & (F.rtrim("value") == F.lit(found[0][2]))))
        else:
            heads = spark.createDataFrame([(n, h) for n, _, h in found], "name string, head string").select("name", F.xxhash64("head").alias("h"))
            is_head = (F.col("file") == F.col("name")) & (F.col("block") == 0) & F.col("value").startswith("{") & (F.xxhash64(F.rtrim(F.regexp_replace("value", r"[\t\r]+$", ""))) == F.col("h"))
            rows = rows.join(F.broadcast(heads), is_head, "left_anti")  # 30 bytes a file, whose heads the driver has read
        return rows.select("value", F.lit(None).cast("long").alias("row_index"), "file")
    # Ids rise by one within a file split's partition; the metadata's lines are a file's first.
    numbered = lines.select("value", file.alias("file"), block.alias("block"), place.alias("place"))
    skips = spark.createDataFrame([(n, s) for n, s, _ in found], "file string, skip int")
    counts = numbered.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("file", "block", "least", before.alias("shift")).join(F.broadcast(skips), "file")  # a row per file split
    placed = numbered.join(F.broadcast(shift), ["file", "block"]).withColumn("row_index", F.col("shift") + F.col("place") - F.col("least") - F.col("skip"))
    return placed.where((F.col("row_index") >= 0) & ~blank).select("value", "row_index", "file")


def verify_records(spark: SparkSession, tables: list[DsjTable]) -> None:
    """Fail where a file's rows are not as many as it declares; one job counts all files."""
    declared = [t for t in tables if t.records >= 0]
    if not declared:
        return
    found = dict(_raw_rows(spark, declared, False).groupBy("file").count().collect())  # a row per file
    for t in declared:
        if found.get(_name(t.path), 0) != t.records:
            raise ValueError(f"{t.path}: {t.records} records declared, {found.get(_name(t.path), 0)} found")


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """(name, declared, parsed, ok) of each file."""
    tables = read_heads(path)
    heads = spark.createDataFrame([(_name(t.path), t.name, t.records) for t in tables], "file string, name string, declared long")
    parsed = _raw_rows(spark, tables, False).groupBy("file").agg(F.count("*").alias("parsed"))
    both = heads.join(parsed, "file", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return both.select("name", "declared", "parsed", ((F.col("declared") < 0) | (F.col("parsed") == F.col("declared"))).alias("ok"))
