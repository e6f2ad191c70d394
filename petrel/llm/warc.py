"""WARC archives: writing, normalising monolithic gzip, and reading by a sidecar index.

``write_monolithic`` lets Spark's text writer make one gzip stream per task, as crawls
that compress a whole file do.  ``normalize`` inflates each such stream once, piece by
piece, and rewrites every record as a gzip member of its own next to a sidecar index of
offsets, so that records can be read at random and in parallel.  ``read_indexed`` reads
ranges of members by that index and checks every digest.  Memory is bounded by a buffer
and the longest record; files reach any store that pyarrow's file systems know, and a
repeated task rewrites its file under a name of its own before it takes the final one.

Records with equal payloads: the one with the largest id is the response, the others are
revisits that refer to it and carry no payload.  Which they are is found from digests
alone (map-side combine, so a hot payload is one row per task); the texts are not shuffled
while the revisits' ids fit a checked bound.

Edge cases: a null html is an empty payload; a null url is an empty target; a null id is
written as an empty field and read as null (it never is the response of a group that has
ids); rows with equal id and payload are all responses or all revisits together; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits at a time make four of its letters."""
    digits = F.sha1(payload)
    out = []
    for i in range(8):
        v = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(ALPHABET), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def archive_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, most_broadcast: int = 1_000_000) -> DataFrame:
    """(record): the WARC record of each page, without its closing blank lines."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20]", "%20").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), base32_sha1(F.encode(html, "UTF-8")).alias("digest"))
    narrow = scratch.save(rows.where(f"size >= {least_bytes}").select("id", "digest"), "digests")
    groups = narrow.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL").select("digest", "keep")
    revisits = narrow.join(groups, "digest").where("id IS NULL OR id <> keep").select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), "keep").distinct()
    revisits = scratch.save(revisits, "revisits")
    few = revisits.count() <= most_broadcast  # some 60 bytes each; more are joined by a shuffle
    rows = rows.join(F.broadcast(revisits) if few else revisits, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    again = F.col("keep").isNotNull()
    head = F.concat(F.lit(HTTP + "Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, head).otherwise(F.concat(head, "html"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("Petrel-Page", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        field("Petrel-Payload-Length", F.col("size").cast("string")),
        F.when(again, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", _record_id(F.col("keep"), F.col("digest"))), field("Petrel-Refers-To-Page", F.col("keep").cast("string")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    return rows.select(record.alias("value"))


def write_monolithic(records: DataFrame, path: str) -> None:
    """One gzip stream for each task's records; the line separator is a record's end.

    The streams are read once and replaced by members, so they are packed for speed.
    """
    records.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", CRLF * 2).text(path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def inflate(chunks):
    """Bytes of a gzip file, whether one stream or many members, in pieces of READ_BYTES at most; a stream that is cut
    anywhere, its trailer included, is an error."""
    z, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            if not begun:
                chunk = chunk.lstrip(b"\0")  # padding between members
                begun = bool(chunk)
                continue
            out = z.decompress(chunk, READ_BYTES)
            if out:
                yield out
            chunk = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                z, begun = zlib.decompressobj(31), False
            elif not chunk:
                while out := z.decompress(b"", READ_BYTES):  # what a full buffer held back
                    yield out
                if z.eof:
                    z, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("gzip stream ends early")


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(parts):
    """(headers, record bytes) of each record of a WARC stream, in order."""
    buffer, need, head = bytearray(), None, None
    for part in parts:
        buffer += part
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = headers_of(bytes(buffer[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(buffer) < need:
                break
            yield head, bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip(b"\r\n"):
        raise ValueError("truncated WARC record")


INDEX = "file string, offset long, length long, type string, target string, digest string"


def _normalize(out_dir: str, level: int):
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _open(uri)
                name = path.rsplit("/", 1)[-1].split(".")[0]
                out_uri = f"{out_dir}/{name}.warc.gz"
                to, final = _open(out_uri)
                part = f"{final}.{uuid.uuid4().hex}"
                rows, offset = [], 0
                with fs.open_input_stream(path, compression=None) as source, to.open_output_stream(part, compression=None) as sink:
                    for head, record in split_records(inflate(iter(lambda: source.read(READ_BYTES), b""))):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        sink.write(member)
                        rows.append((out_uri, offset, len(member), head["warc-type"], head.get("warc-target-uri"), head.get("warc-payload-digest")))
                        offset += len(member)
                to.move(part, final)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                for i in range(0, len(rows), 10_000):
                    cols = zip(*rows[i : i + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "offset", "length", "type", "target", "digest"])

    return run


def normalize(spark: SparkSession, in_dir: str, out_dir: str, level: int = 4) -> DataFrame:
    """Rewrite the archives of in_dir with a member a record under out_dir; the sidecar index is out_dir/index."""
    files = spark.read.format("binaryFile").load(in_dir).where("length > 0").select("path")
    _mkdirs(spark, out_dir)
    index = files.repartition(max(1, min(10_000, files.count()))).mapInArrow(_normalize(out_dir, level), INDEX)
    index.write.mode("overwrite").parquet(f"{out_dir}/index")
    return spark.read.schema(index.schema).parquet(f"{out_dir}/index")


def _mkdirs(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


READ = "page long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches):
    def number(x):
        return int(x) if x else None

    for batch in batches:
        for uri, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, path = _open(uri)
            rows, first, last = [], members[0]["offset"], members[-1]["offset"] + members[-1]["length"]
            with fs.open_input_file(path) as source:
                source.seek(first)
                data = memoryview(source.read(last - first))
            for m in members:
                z = zlib.decompressobj(31)
                at = m["offset"] - first
                record = z.decompress(data[at : at + m["length"]])
                if not z.eof or z.unused_data:
                    raise ValueError(f"{uri}: no whole member at {m['offset']}")
                end = record.index(b"\r\n\r\n")
                head = headers_of(record[:end])
                block = record[end + 4 : end + 4 + int(head["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["petrel-payload-length"])
                if head["warc-type"] == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    size = len(payload)
                rows.append((number(head["petrel-page"]), size, digest, head["warc-type"], number(head.get("petrel-refers-to-page"))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_indexed(index: DataFrame, block_bytes: int = BLOCK_BYTES, most_tasks: int = 20_000) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to) of every record, read by ranges of the index."""
    block = F.expr(f"offset div {block_bytes}").alias("block")
    # A block's members: 16 bytes each, of a block that itself is read into memory.
    ranges = index.groupBy("file", block).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))
    # A task for each block up to most_tasks, counted from the index: its few rows say nothing of the archives' bytes.
    blocks = index.select("file", block).distinct().count()
    return ranges.select("file", "members").repartition(max(1, min(most_tasks, blocks))).mapInArrow(_read, READ)


def archive_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write, normalise and read back: a row per page."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    write_monolithic(archive_records(pages, scratch), scratch.path("monolithic"))
    index = normalize(spark, scratch.path("monolithic"), scratch.path("members"))
    scratch.drop("monolithic", "digests", "revisits")
    return read_indexed(index)


#: DuckDB: op2's rows from the table. Base32 by five hex digits of the SHA-1 at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, html, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keep FROM d GROUP BY payload_digest)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d JOIN k USING (payload_digest)
"""
