"""Registry of the library's queries and of the DuckDB SQL that checks them.

Scans are checked by round trips: a table is encoded to the format under test by fixture
writers, read back by the source, and must equal the table.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import metadata
from ..codecs import charsets
from ..functions import buffers, mapping, numeric, temporal
from ..operators import tables
from ..session import configure
from ..sources import dsj
from ..testing import encoders, fixtures

MICRO = 1e6
EPOCH_SHIFT = temporal.SAS_TO_UNIX


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Dataset-JSON

def _column(name: str, kind: str, target: str | None = None, key: int | None = None) -> dict:
    out = {"itemOID": f"IT.{name}", "name": name, "label": name.lower(), "dataType": kind}
    return out | ({"targetDataType": target} if target else {}) | ({"keySequence": key} if key else {})


ORDER_COLUMNS = [_column("ORDERKEY", "integer", key=1), _column("STATUS", "string"), _column("PRICE", "double"), _column("ODATE", "date", "integer")]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("odate"))


def orders_dsj(spark: SparkSession, sf_dir: str, container: str = "PLAIN", nested: bool = False) -> str:
    path = fixtures.folder(spark, "dsj")
    return fixtures.write_files(_orders(spark, sf_dir), path, fixtures.dsj_bytes(ORDER_COLUMNS, container, nested, "ORDERS"), ".json" if nested else ".ndjson")


def _scan(container: str = "PLAIN", nested: bool = False):
    def run(spark, sf_dir):
        rows = dsj.read_dsj(spark, orders_dsj(spark, sf_dir, container, nested))
        return rows.select(F.col("ORDERKEY").alias("orderkey"), F.col("STATUS").alias("status"), F.col("PRICE").alias("price"), F.col("ODATE").alias("odate"))

    return run


SCAN_SQL = "SELECT o_orderkey::DOUBLE AS orderkey, o_orderstatus AS status, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS odate FROM orders"


def dsj_targets(spark, sf_dir):
    """Target data type integer: dates come as SAS day numbers."""
    rows = dsj.read_dsj(spark, orders_dsj(spark, sf_dir), apply_targets=True)
    return rows.select(F.col("ORDERKEY").alias("orderkey"), F.col("ODATE").alias("sas_date"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as NDJSON, read back with their target types: orders and revenue by month."""
    rows = dsj.read_dsj(spark, orders_dsj(spark, sf_dir), apply_targets=True)
    month = F.substring(temporal.iso_from_sas_date(F.col("ODATE")), 1, 7)
    return rows.groupBy(month.alias("month")).agg(F.count("*").alias("orders"), F.round(F.sum("PRICE"), 2).alias("revenue"))


def _one_file(spark, sf_dir):
    path = fixtures.folder(spark, "dsj-one")
    return fixtures.write_files(_orders(spark, sf_dir).orderBy("o_orderkey").coalesce(1), path, fixtures.dsj_bytes(ORDER_COLUMNS, name="ORDERS"), ".ndjson")


def dsj_row_index(spark, sf_dir):
    rows = dsj.read_dsj(spark, _one_file(spark, sf_dir), row_index=True)
    return rows.select(F.col("_row_index").alias("row_index"), F.col("ORDERKEY").alias("orderkey"))


def dsj_slices(spark, sf_dir):
    return tables.slices(dsj.read_dsj(spark, _one_file(spark, sf_dir), row_index=True), rows=dsj.SLICE_ROWS)


def dsj_record_count(spark, sf_dir):
    found = dsj.record_counts(spark, orders_dsj(spark, sf_dir))
    return found.groupBy("name").agg(F.sum("declared").alias("declared"), F.sum("parsed").alias("parsed"), F.min("ok").alias("ok"))


def dsj_tables(spark, sf_dir):
    t = metadata.dsj_tables(spark, _one_file(spark, sf_dir))
    return t.select("container", "nested", "version", "item_group_oid", "name", "records", "column_count")


def dsj_columns(spark, sf_dir):
    return metadata.dsj_columns(spark, _one_file(spark, sf_dir)).select("index", "name", "label", "data_type", "target_type", "key_sequence")


def dsj_key_order(spark, sf_dir):
    rows = dsj.read_dsj(spark, orders_dsj(spark, sf_dir))
    return rows.orderBy(*tables.key_order(rows)).select(F.col("ORDERKEY").alias("orderkey"))


def dsj_key_rank(spark, sf_dir):
    """The whole table in key order: every row with its rank."""
    rows = dsj.read_dsj(spark, orders_dsj(spark, sf_dir))
    return tables.key_ranked(rows, fixtures.folder(spark, "dsj-ranked")).select("key_rank", F.col("ORDERKEY").alias("orderkey"))


_META = {"datasetJSONCreationDateTime": "2025-01-01T00:00:00", "datasetJSONVersion": "1.1.0", "itemGroupOID": "IG.T", "name": "T", "label": "t"}
_TWO = [_column("N", "integer"), _column("S", "string")]


def _head(columns=_TWO, **more) -> dict:
    return _META | ({} if columns is None else {"columns": columns}) | more


def _lines(head: dict, *rows: str) -> str:
    return "\n".join([json.dumps(head), *rows]) + "\n"


def _nested(head: dict, tail: str) -> str:
    return json.dumps(head)[:-1] + tail


#: What a file holds and what reading it gives: its number of rows, or a part of the error's text.
INTEGRITY = [
    ("A2 too short", "{", "too short"),
    ("A2 other bytes", "<xml/>", "not Dataset-JSON"),
    ("A7 unknown members", _lines(_head(extra={"deep": [1, 2.5, None, True, {"x": "y"}]}, huge=10**30), '[1, "a"]'), "1 rows"),
    ("A7 not a number", _lines(_head(), '[1, "a"]').replace('"T"', "NaN", 1), "is not JSON"),
    ("A8 column without type", _lines(_head([{k: v for k, v in _column("N", "integer").items() if k != "dataType"}]), "[1]"), "missing dataType"),
    ("A9 rows before columns", _nested(_head(None), ', "rows": [[1, "a"]], "columns": []}'), "columns must come before the rows"),
    ("A9 no columns", _lines(_head(None)), "missing columns"),
    ("A10 member after rows", _nested(_head(), ', "rows": [[1, "a"], [2, "b"]], "more": 1}'), "2 rows"),
    ("A11 rows twice", _nested(_head(), ', "rows": [[1, "a"]], "rows": [[2, "b"]]}'), "Rows already parsed"),
    ("A12 no rows", _lines(_head()), "0 rows"),
    ("A12 empty rows", _nested(_head(records=0), ', "rows": []}'), "0 rows"),
    ("A13 few values", _lines(_head(), '[1, "a"]', "[2]"), "has 1 values, 2 expected"),
    ("A13 many values", _lines(_head(), '[1, "a", 3]'), "has 3 values, 2 expected"),
    ("A14 row is an object", _lines(_head(), '{"N": 1}'), "not a row"),
    ("A14 stray bracket", _lines(_head(), '[1, "a"]]'), "not a row"),
    ("A14 nested row is a number", _nested(_head(), ', "rows": [7]}'), "not a row"),
    ("A15 fewer records", _lines(_head(records=3), '[1, "a"]'), "3 records declared, 1 found"),
    ("A15 right records", _lines(_head(records=1), '[1, "a"]'), "1 rows"),
    ("A16 records absent", _lines(_head(), '[1, "a"]'), "1 rows"),
    ("A16 records as text", _lines(_head(records="five"), '[1, "a"]'), "1 rows"),
    ("A16 records beyond long", _lines(_head(records=10**20), '[1, "a"]'), "does not fit 64 bits"),
    ("A17 length beyond int", _lines(_head([_column("N", "integer") | {"length": 1 << 40}]), "[1]"), "does not fit 32 bits"),
    ("A17 key beyond int", _lines(_head([_column("N", "integer", key=1 << 33)]), "[1]"), "does not fit 32 bits"),
    ("A18 system is a text", _lines(_head(sourceSystem="x"), '[1, "a"]'), "1 rows"),
    ("A18 system without version", _lines(_head(sourceSystem={"name": "x"}), '[1, "a"]'), "sourceSystem without version"),
    ("C3 text in numbers", _lines(_head(), '["1", "a"]'), "Invalid value in N"),
    ("C3 truth in numbers", _lines(_head(), '[true, "a"]'), "Invalid value in N"),
    ("C3 null in numbers", _lines(_head(), '[null, "a"]'), "1 rows"),
    ("C4 any value in texts", _lines(_head(), "[1, 12]", "[2, true]", '[3, {"k": [1]}]', "[4, null]"), "4 rows"),
]


def dsj_integrity(spark, sf_dir):
    """Files that keep or break the format's rules, one by one: what reading each gives."""
    configure(spark)
    path = fixtures.folder(spark, "dsj-integrity")
    found = []
    for i, (case, text, want) in enumerate(INTEGRITY):
        name = f"{path}/case{i}.json"
        fixtures.write_bytes(name, text.encode())
        try:
            found.append((case, f"{len(dsj.read_dsj(spark, name).collect())} rows"))  # a handful of rows each
        except Exception as error:  # noqa: BLE001  the outcome under test
            found.append((case, want if want in str(error) else f"{type(error).__name__}: {str(error)[:200]}"))
    return spark.createDataFrame(found, "case string, outcome string")


INTEGRITY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{want}')" for case, _, want in INTEGRITY) + ') t("case", outcome)'


def dsj_string_cells(spark, sf_dir):
    """C4: what the string buffer holds of numbers, truth values, objects and nulls."""
    configure(spark)
    path = f"{fixtures.folder(spark, 'dsj-cells')}/cells.json"
    cells = ["1", "12345678901234567890", "true", "null", '"a \\" b"', '{"k":[1,2]}', "[1,null]"]
    fixtures.write_bytes(path, _lines(_head(), *(f"[{i}, {x}]" for i, x in enumerate(cells))).encode())
    return dsj.read_dsj(spark, path).select(F.col("N").alias("n"), F.col("S").alias("s"))


def dsj_folder_rows(spark, sf_dir):
    """A6, A26: many files of one layout in one plan, the rows of each numbered from 0."""
    path = fixtures.folder(spark, "dsj-many")
    fixtures.write_files(_orders(spark, sf_dir).repartition(40, "o_orderkey").sortWithinPartitions("o_orderkey"), path, fixtures.dsj_bytes(ORDER_COLUMNS, name="ORDERS"), ".ndjson")
    rows = dsj.read_dsj(spark, path, row_index=True)
    return rows.agg(F.count("*").alias("n"), F.sum("ORDERKEY").alias("keys"), F.count_if(F.col("_row_index") == 0).alias("firsts"))


def container_kinds(spark, sf_dir):
    """First bytes to container, on every order key as four bytes behind a chosen pair."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("k"))
    head = F.unhex(F.element_at(F.array(F.lit("1F8B"), F.lit("789C"), F.lit("7B0A"), F.lit("5B5D"), F.lit("1F")), (F.col("k") + 1).cast("int")))
    return o.groupBy(mapping.container(head).alias("container")).agg(F.count("*").alias("n"))


# Transport files

LINE_NAMES = {"l_orderkey": "LOKEY", "l_linenumber": "LNUM", "l_quantity": "LQTY", "l_extendedprice": "LPRICE", "l_discount": "LDISC", "l_returnflag": "LFLAG"}


def lineitem_xpt(spark: SparkSession, sf_dir: str) -> str:
    path = fixtures.folder(spark, "xpt")
    return fixtures.write_files(_t(spark, sf_dir, "lineitem").select(*LINE_NAMES), path, fixtures.xpt_bytes({"l_returnflag": 1}, LINE_NAMES, "LINES"), ".xpt")


def xpt_scan_lineitem(spark, sf_dir):
    rows = spark.read.format("xpt").load(lineitem_xpt(spark, sf_dir))
    return rows.select(*[F.col(v).alias(k) for k, v in LINE_NAMES.items()])


def xpt_pruned(spark, sf_dir):
    rows = spark.read.format("xpt").option("columns", "LQTY,LFLAG").load(lineitem_xpt(spark, sf_dir))
    return rows.groupBy(F.col("LFLAG").alias("flag")).agg(F.sum("LQTY").alias("qty"), F.count("*").alias("n"))


def _two_members(spark, sf_dir):
    path = fixtures.folder(spark, "xpt-two")
    regions = _t(spark, sf_dir, "region")
    names = regions.orderBy("r_regionkey").select("r_regionkey", "r_name").collect()  # five rows by the benchmark's definition
    more = encoders.xpt_member("REGION", [("KEY", encoders.numeric_cells([r[0] for r in names]), True), ("NAME", encoders.char_cells([r[1] for r in names], 25), False)])
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1)
    return fixtures.write_files(nations, path, fixtures.xpt_bytes({"n_name": 25}, {"n_nationkey": "KEY", "n_name": "NAME"}, "NATION", [more]), ".xpt")


def xpt_member_ends(spark, sf_dir):
    """X5: names of customers as 30-byte cells, of which some are blank, and what ends the member after them."""
    names = ["A" * 30]
    tag = "HEADER RECORD*******"
    cases = [("tag after padding", " " * 20 + tag + " " * 60), ("tag in one observation", " " * 10 + tag), ("tag at its start", tag + " " * 10), ("look-alike", "HEADER RECORD**HELLO".ljust(30)), ("tag not after blanks", "B" + tag + "C" * 9), ("blank rest", " " * 50), ("blank observation", " " * 30 + "D" * 30), ("data in the rest", "E" * 12)]
    path, found = fixtures.folder(spark, "xpt-ends"), []
    whole = encoders.xpt_file([encoders.xpt_member("M", [("T", encoders.char_cells(names, 30), False)])])
    head = whole[: whole.index(b"A" * 30)]
    configure(spark)
    for i, (case, rest) in enumerate(cases):
        name = f"{path}/case{i}.xpt"
        fixtures.write_bytes(name, head + b"A" * 30 + rest.encode())
        for blank in ("end", "padding"):
            try:
                n = str(spark.read.format("xpt").option("blankFrame", blank).load(name).count())
            except Exception as error:  # noqa: BLE001  the outcome under test
                n = "truncated" if "Truncated XPT file" in str(error) else str(error)[:200]
            found.append((case, blank, n))
    return spark.createDataFrame(found, "case string, blank string, outcome string")


XPT_ENDS_SQL = """
SELECT c AS "case", b AS blank, CASE b WHEN 'end' THEN e ELSE p END AS outcome FROM (VALUES
  ('tag after padding', '1', '1'), ('tag in one observation', '1', '1'), ('tag at its start', '1', '1'), ('look-alike', '2', '2'),
  ('tag not after blanks', '2', '2'), ('blank rest', '1', '1'), ('blank observation', '1', '3'), ('data in the rest', 'truncated', 'truncated')) t(c, e, p),
  (VALUES ('end'), ('padding')) u(b)
"""


def xpt_members(spark, sf_dir):
    path = _two_members(spark, sf_dir)
    parts = [spark.read.format("xpt").option("member", m).load(path).select(F.lit(m).alias("member"), F.col("KEY").alias("key"), F.col("NAME").alias("name")) for m in ("NATION", "REGION")]
    return parts[0].unionByName(parts[1])


def xpt_variables(spark, sf_dir):
    return metadata.xpt_variables(spark, _two_members(spark, sf_dir)).select("member", "number", "name", "type", "length", "position")


def xpt_member_headers(spark, sf_dir):
    return metadata.xpt_members(spark, _two_members(spark, sf_dir)).select("name", "version", "os", "variables", "descriptor", F.date_format("created", "yyyy-MM-dd").alias("created"), "row_count")


def xpt_missing_tags(spark, sf_dir):
    """Balances below zero are written as missing values: null in the column, the tag beside it."""
    path = fixtures.folder(spark, "xpt-missing")
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("KEY"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("BAL"))
    fixtures.write_files(rows, path, fixtures.xpt_bytes({}, {}, "CUST"), ".xpt")
    return spark.read.format("xpt").option("missingTags", "true").load(path).select(F.col("KEY").alias("key"), F.col("BAL").alias("bal"), F.col("BAL__mv").alias("tag"))


def ibm_roundtrip(spark, sf_dir):
    """Prices as IBM floats, decoded by the SQL form."""
    import pyarrow as pa

    def encode(batches):
        for b in batches:
            cells = encoders.numeric_cells(b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([bytes(c) for c in cells], pa.binary())], names=["k", "n", "raw"])

    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_linenumber").mapInArrow(encode, "k long, n int, raw binary")
    return rows.select(F.col("k").alias("orderkey"), F.col("n").alias("linenumber"), numeric.ibm_double(F.col("raw")).alias("price"))


HEADER_STAMPS = "16FEB11:10:07:55 01jan60:00:00:00 31DEC1999:23:59:59 29FEB2024:12:00:00 30FEB24:00:00:00 1JAN20:00:00:00".split()


def xpt_header_times(spark, sf_dir):
    configure(spark)
    rows = spark.createDataFrame([(x,) for x in HEADER_STAMPS], "text string")
    ts = temporal.header_timestamp(F.col("text"), 2026)
    return rows.select("text", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


# SAS7BDAT

CUSTOMER_WIDTHS = {"c_name": 25, "c_mktsegment": 12}


def _customers(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def customer_bdat(spark: SparkSession, sf_dir: str, **options) -> str:
    return fixtures.write_files(_customers(spark, sf_dir), fixtures.folder(spark, "bdat"), fixtures.bdat_bytes(CUSTOMER_WIDTHS, name="CUSTOMER", **options), ".sas7bdat")


def _bdat(**options):
    def run(spark, sf_dir):
        return spark.read.format("sas7bdat").option("verify", "true").load(customer_bdat(spark, sf_dir, **options))

    return run


BDAT_SQL = "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _seventh(table) -> np.ndarray:
    return table.column("c_custkey").to_numpy() % 7 == 0


def bdat_deleted_counts(spark, sf_dir):
    path = customer_bdat(spark, sf_dir, deleted=_seventh)
    return tables.deleted_count(spark.read.format("sas7bdat").option("includeDeleted", "true").load(path))


def bdat_deleted_page(spark, sf_dir):
    """B30: the first hundred customers are deleted, so whole pages are, and the rows behind them still come."""
    gone = lambda table: table.column("c_custkey").to_numpy() <= 100
    return spark.read.format("sas7bdat").option("verify", "true").load(customer_bdat(spark, sf_dir, deleted=gone))


def bdat_headers(spark, sf_dir):
    """B6: the fields of a file's last header part are read and alike in all files."""
    d = metadata.bdat_datasets(spark, customer_bdat(spark, sf_dir))
    return d.groupBy("server", "os_name").agg((F.count("*") > 0).alias("some")).select(F.col("server").isNotNull().alias("server"), F.col("os_name").isNotNull().alias("os_name"), "some")


def bdat_datasets(spark, sf_dir):
    path = customer_bdat(spark, sf_dir, compression="SASYZCRL", deleted=_seventh)
    d = metadata.bdat_datasets(spark, path)
    return d.groupBy("name", "platform", "bits", "charset", "compression", "column_count", "row_length").agg(F.sum("row_count").alias("row_count"), F.sum("deleted_count").alias("deleted_count"))


def bdat_variables(spark, sf_dir):
    return metadata.bdat_variables(spark, customer_bdat(spark, sf_dir)).select("index", "name", "type", "offset", "width", "sort_order").distinct()


def library_min_max(spark, sf_dir):
    """Members of a folder by market segment, created when the segment's first customer key says, in seconds."""
    path = fixtures.folder(spark, "bdat-library")
    segments = _customers(spark, sf_dir).groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first"))
    for row in segments.collect():  # five segments by the benchmark's definition
        one = _customers(spark, sf_dir).where(F.col("c_mktsegment") == row[0]).coalesce(1)
        fixtures.write_files(one, path, fixtures.bdat_bytes(CUSTOMER_WIDTHS, name=row[0][:8], created=86400.0 * row[1]), ".sas7bdat")
    lib = metadata.bdat_library(spark, path)
    return lib.select(F.date_format("created", "yyyy-MM-dd").alias("created"), F.date_format("modified", "yyyy-MM-dd").alias("modified"), "members")


def sort_order_decode(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).cast("int").alias("raw"))
    return o.select("o_orderkey", tables.sort_order(F.col("raw")).alias("sort_order"))


def variable_names_last(spark, sf_dir):
    """Parts by type in lower case: of those with equal names the one with the largest key."""
    p = _t(spark, sf_dir, "part").select(F.lit("PART").alias("member"), F.col("p_type").alias("name"), F.col("p_partkey").alias("index"))
    return tables.last_named(p, "member").select(F.lower("name").alias("name"), "index")


# Values

def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "ts", "value", (F.col("event_id") % 4).alias("k"))


def sas_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+02:00").otherwise(""))
    return o.select("o_orderkey", temporal.sas_date(text).alias("sas_date"))


def sas_datetime(spark, sf_dir):
    """Naive, UTC and offset texts of one moment give one number."""
    e = _events(spark, sf_dir)
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    plus = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOUR"), fmt)
    minus = F.date_format(F.col("ts") - F.expr("INTERVAL 5 HOUR 30 MINUTE"), fmt)
    text = F.when(F.col("k") == 0, F.date_format("ts", fmt)).when(F.col("k") == 1, F.concat(F.date_format("ts", fmt), F.lit("Z"))).when(F.col("k") == 2, F.concat(plus, F.lit("+02:00"))).otherwise(F.concat(minus, F.lit("-05:30")))
    return e.select("event_id", F.round(temporal.sas_datetime(text), 6).alias("sas_datetime"))


def sas_time(spark, sf_dir):
    e = _events(spark, sf_dir)
    text = F.when(F.col("k") == 0, F.date_format("ts", "HH:mm")).when(F.col("k") == 1, F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("+02:00"))).otherwise(F.date_format("ts", "HH:mm:ss.SSS"))
    return e.select("event_id", F.round(temporal.sas_time(text), 6).alias("sas_time"))


TIME_SQL = """
SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60
  WHEN 1 THEN ((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) - 7200 + 86400) % 86400
  ELSE hour(ts) * 3600 + minute(ts) * 60 + (epoch_us(ts) // 1000 % 60000) / 1000.0 END::DOUBLE, 6) AS sas_time FROM events
"""


def temporal_rejects(spark, sf_dir):
    """Texts that Spark's casts take and ISO's grammars do not, and some that both take."""
    configure(spark)
    texts = ["2025-06-15 10:30:00", "2025", "2025-06", "2025-02-30", "2025-13-45", "25:99:99", "24:00:00", "10:30", "10:30:00Z", "2025-06-15T10:30", "2025-06-15T10:30:00+25:00", "not-a-date", "", "2025-06-15", "2025-06-15Z"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    x = F.col("text")
    return rows.select("text", temporal.sas_datetime(x).isNotNull().alias("datetime"), temporal.sas_date(x).isNotNull().alias("date"), temporal.sas_time(x).isNotNull().alias("time"))


REJECT_SQL = r"""
SELECT text, text IN ('2025-06-15T10:30') AS "datetime", text IN ('2025-06-15', '2025-06-15Z') AS "date", text IN ('10:30', '10:30:00Z') AS "time"
FROM (SELECT unnest(['2025-06-15 10:30:00', '2025', '2025-06', '2025-02-30', '2025-13-45', '25:99:99', '24:00:00', '10:30', '10:30:00Z', '2025-06-15T10:30', '2025-06-15T10:30:00+25:00', 'not-a-date', '', '2025-06-15', '2025-06-15Z']) AS text)
"""


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def iso_from_sas_datetime(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", temporal.iso_from_sas_datetime(_micros("ts") / MICRO + EPOCH_SHIFT).alias("iso"))


def iso_from_unix_datetime(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", temporal.iso_from_unix_datetime(_micros("ts") / MICRO).alias("iso"))


ISO_SQL = "SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '\\.$', '') AS iso FROM events"


def iso_from_sas_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    days = F.datediff("o_orderdate", F.lit("1960-01-01").cast("date")) + (F.col("o_orderkey") % 2) * 0.4
    return o.select("o_orderkey", temporal.iso_from_sas_date(days).alias("iso"))


def iso_from_unix_date(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", temporal.iso_from_unix_date(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("double")).alias("iso"))


def iso_from_sas_time(spark, sf_dir):
    """Keys as seconds and quarters of one, days and more, and below zero."""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", temporal.iso_from_sas_time(F.col("o_orderkey") * 7.25 - 50000).alias("iso"))


ISO_TIME_SQL = r"""
WITH t AS (SELECT o_orderkey, ((o_orderkey * 7.25 - 50000) % 86400 + 86400) % 86400 AS s FROM orders),
u AS (SELECT o_orderkey, floor(s)::BIGINT AS w, round((s - floor(s)) * 100)::INT AS c FROM t)
SELECT o_orderkey, printf('%02d:%02d:%02d', w // 3600, w // 60 % 60, w % 60) || CASE c WHEN 0 THEN '' WHEN 25 THEN '.25' WHEN 50 THEN '.5' ELSE '.75' END AS iso FROM u
"""


def sas_timestamps(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    seconds = F.col("o_orderkey") * 86399.5 - 3e8
    return o.select("o_orderkey", temporal.moment_text(temporal.sas_timestamp(seconds)).alias("moment"))


def thousands_decimal(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", numeric.decimal_value(F.format_number("o_totalprice", 2)).alias("price"))


NUMBERS = ["1,234", "1,234.5", "1,234,567", "-1,234", "+1,234", "12,345", "123,456", "999,999,999", " 1,234", "1,5", "1,23", "1,2345", "1.234,5", "0,123", "1,234.5,6", ",123", "1,,234", "1234,567", "", "12", "1e3", "0x1p3", "12.5d", ".5", "1.", "inf", "INF", "Infinity", "-Infinity", "infinity", "NaN", "nan", "abc"]


def thousands_reject(spark, sf_dir):
    configure(spark)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, text string")
    value = numeric.decimal_value(F.col("text"))
    return rows.select("i", "text", numeric.without_thousands(F.col("text")).alias("plain"), F.isnan(value).alias("is_nan"))


THOUSANDS_SQL = "SELECT i::INT AS i, text, CASE WHEN instr(text, ',') = 0 THEN text WHEN regexp_full_match(text, '[\\x00-\\x20]*[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(|[^0-9,][^,]*)') THEN replace(text, ',', '') END AS plain, (NOT regexp_full_match(text, '[ ]*[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\\.[0-9]+)?') AND text NOT IN ('12', '1e3', '0x1p3', '12.5d', '.5', '1.', 'Infinity', '-Infinity')) AS is_nan FROM (SELECT unnest(range(" + str(len(NUMBERS)) + ")) AS i, unnest([" + ", ".join("'" + x + "'" for x in NUMBERS) + "]) AS text)"


def buffer_long_missing(spark, sf_dir):
    """Values with some made null and some NaN: as longs, and which are missing."""
    e = _events(spark, sf_dir)
    x = F.when(F.col("k") == 0, F.lit(None).cast("double")).when(F.col("k") == 1, F.lit("NaN").cast("double")).otherwise(F.col("value") * 10 - 5)
    return e.select("event_id", buffers.as_long(x).alias("as_long"), buffers.is_missing(x).alias("missing"), F.isnan(buffers.long_as_double(buffers.nullable_long(x))).alias("nan_back"))


def type_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    text = F.element_at(F.array(*[F.lit(x) for x in ("String", "INTEGER", "Double", "DateTime", "blob", "URI")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.groupBy(mapping.type_name(text).alias("kind")).agg(F.count("*").alias("n"))


def target_mapping(spark, sf_dir):
    """The mapping that each data type and target asks for, applied to one text each."""
    configure(spark)
    cases = [("datetime", "integer", "1960-01-02T00:00:00"), ("date", "integer", "1960-01-02"), ("time", "integer", "01:02:03"), ("string", "integer", "1,234"), ("decimal", "decimal", "1,234.5"), ("float", "decimal", "2.5"), ("decimal", "decimal", "abc")]
    out = None
    for kind, target, text in cases:
        one = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(target).alias("target"), mapping.target_mapper(kind, target)(F.lit(text)).alias("value"))
        out = one if out is None else out.union(one)
    return out


def unix_mapping(spark, sf_dir):
    """V4f: the way back from Unix numbers by data type; other types stay as they are."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("double").alias("days"))
    value = {"date": F.col("days"), "datetime": F.col("days") * 86400, "string": F.col("days")}
    return o.select("o_orderkey", *[mapping.unix_inverse_mapper(kind)(x).cast("string").alias(f"of_{kind}") for kind, x in value.items()])


def sas_datetime_regions(spark, sf_dir):
    """V1: offsets of up to 18 hours, and regions behind them, which do not change the moment."""
    configure(spark)
    rows = spark.createDataFrame([(x,) for x, _ in REGIONS], "text string")
    return rows.select("text", temporal.sas_datetime(F.col("text")).alias("seconds"))


REGIONS = [("1960-01-02T01:00:00+01:00[Europe/Paris]", 86400), ("1960-01-02T00:00:00Z[UTC]", 86400), ("1960-01-02T00:00:00[Europe/Paris]", None), ("1960-01-02T18:00:00+18:00", 86400), ("1960-01-02T18:30:00+18:30", None), ("1960-01-01T06:00:00-18:00", 86400), ("1960-01-02T00:00:00+00:00[]", None), ("1960-01-02T00:00:30+00:00:30", 86400)]


def encoding_lookup(spark, sf_dir):
    """Encoding ids, their character sets, and which id a name maps back to."""
    configure(spark)
    return charsets.encodings(spark)


def header_texts(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", temporal.header_text(F.col("ts")).alias("text"))


QUERIES = {
    "orders_by_month": (flagship, "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1"),
    "dsj_ndjson_scan_orders": (_scan(), SCAN_SQL),
    "dsj_gzip_scan": (_scan("GZIP"), SCAN_SQL),
    "dsj_zlib_scan": (_scan("ZLIB"), SCAN_SQL),
    "dsj_nested_scan": (_scan("PLAIN", True), SCAN_SQL),
    "dsj_targets": (dsj_targets, "SELECT o_orderkey::DOUBLE AS orderkey, date_diff('day', DATE '1960-01-01', o_orderdate)::DOUBLE AS sas_date FROM orders"),
    "dsj_row_index": (dsj_row_index, "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey::DOUBLE AS orderkey FROM orders"),
    "dsj_slices": (dsj_slices, "SELECT r // 1000 AS slice_index, min(r) AS first_row, count(*) AS row_count FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) GROUP BY 1"),
    "dsj_record_count": (dsj_record_count, "SELECT 'ORDERS' AS name, count(*)::BIGINT AS declared, count(*)::BIGINT AS parsed, true AS ok FROM orders"),
    "dsj_tables": (dsj_tables, "SELECT 'PLAIN' AS container, false AS nested, '1.1.0' AS version, 'IG.ORDERS' AS item_group_oid, 'ORDERS' AS name, count(*) AS records, 4 AS column_count FROM orders"),
    "dsj_columns": (dsj_columns, "SELECT * FROM (VALUES (0, 'ORDERKEY', 'orderkey', 'integer', NULL, 1), (1, 'STATUS', 'status', 'string', NULL, -1), (2, 'PRICE', 'price', 'double', NULL, -1), (3, 'ODATE', 'odate', 'date', 'integer', -1)) t(index, name, label, data_type, target_type, key_sequence)"),
    "dsj_key_order": (dsj_key_order, "SELECT o_orderkey::DOUBLE AS orderkey FROM orders ORDER BY o_orderkey"),
    "dsj_key_rank": (dsj_key_rank, "SELECT row_number() OVER (ORDER BY o_orderkey) AS key_rank, o_orderkey::DOUBLE AS orderkey FROM orders"),
    "dsj_integrity": (dsj_integrity, INTEGRITY_SQL),
    "dsj_string_cells": (dsj_string_cells, "SELECT n::DOUBLE AS n, s FROM (VALUES (0, '1'), (1, '12345678901234567890'), (2, 'true'), (3, NULL), (4, 'a \" b'), (5, '{\"k\":[1,2]}'), (6, '[1,null]')) t(n, s)"),
    "dsj_folder_rows": (dsj_folder_rows, "SELECT count(*) AS n, sum(o_orderkey)::DOUBLE AS keys, 40::BIGINT AS firsts FROM orders"),
    "container_kinds": (container_kinds, "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'GZIP' WHEN 1 THEN 'ZLIB' WHEN 2 THEN 'PLAIN' ELSE 'UNKNOWN' END AS container, count(*) AS n FROM orders GROUP BY 1"),
    "xpt_scan_lineitem": (xpt_scan_lineitem, "SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem"),
    "xpt_pruned": (xpt_pruned, "SELECT l_returnflag AS flag, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1"),
    "xpt_members": (xpt_members, "SELECT 'NATION' AS member, n_nationkey::DOUBLE AS key, n_name AS name FROM nation UNION ALL SELECT 'REGION', r_regionkey::DOUBLE, r_name FROM region"),
    "xpt_member_ends": (xpt_member_ends, XPT_ENDS_SQL),
    "xpt_variables": (xpt_variables, "SELECT m AS member, n AS number, v AS name, t AS type, l AS length, p AS position FROM (VALUES ('NATION', 1, 'KEY', 'NUMERIC', 8, 0), ('NATION', 2, 'NAME', 'CHARACTER', 25, 8), ('REGION', 1, 'KEY', 'NUMERIC', 8, 0), ('REGION', 2, 'NAME', 'CHARACTER', 25, 8)) x(m, n, v, t, l, p)"),
    "xpt_member_headers": (xpt_member_headers, "SELECT n AS name, '9.4' AS version, 'Linux' AS os, 2 AS variables, 140 AS descriptor, '2020-01-01' AS created, NULL::BIGINT AS row_count FROM (VALUES ('NATION'), ('REGION')) x(n)"),
    "xpt_missing_tags": (xpt_missing_tags, "SELECT c_custkey::DOUBLE AS key, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, CASE WHEN c_acctbal < 0 THEN '.' END AS tag FROM customer"),
    "xpt_header_times": (xpt_header_times, "SELECT * FROM (VALUES ('16FEB11:10:07:55', '2011-02-16T10:07:55'), ('01jan60:00:00:00', '1960-01-01T00:00:00'), ('31DEC1999:23:59:59', '1999-12-31T23:59:59'), ('29FEB2024:12:00:00', '2024-02-29T12:00:00'), ('30FEB24:00:00:00', NULL), ('1JAN20:00:00:00', NULL)) t(text, iso)"),
    "ibm_roundtrip": (ibm_roundtrip, "SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_extendedprice AS price FROM lineitem"),
    "bdat_scan_customer": (_bdat(), BDAT_SQL),
    "bdat_scan_32_big": (_bdat(wide=False, little=False), BDAT_SQL),
    "bdat_rle_scan": (_bdat(compression="SASYZCRL"), BDAT_SQL),
    "bdat_rdc_scan": (_bdat(compression="SASYZCR2"), BDAT_SQL),
    "bdat_deleted_rows": (_bdat(deleted=_seventh), BDAT_SQL + " WHERE c_custkey % 7 <> 0"),
    "bdat_deleted_compressed": (_bdat(deleted=_seventh, compression="SASYZCRL"), BDAT_SQL + " WHERE c_custkey % 7 <> 0"),
    "bdat_deleted_counts": (bdat_deleted_counts, "SELECT count(*) FILTER (c_custkey % 7 = 0) AS deleted, count(*) AS total FROM customer"),
    "bdat_deleted_page": (bdat_deleted_page, BDAT_SQL + " WHERE c_custkey > 100"),
    "bdat_headers": (bdat_headers, "SELECT true AS server, true AS os_name, true AS some"),
    "bdat_datasets": (bdat_datasets, "SELECT 'CUSTOMER' AS name, 'UNIX' AS platform, 64 AS bits, 'UTF-8' AS charset, 'SASYZCRL' AS compression, 5::BIGINT AS column_count, 61::BIGINT AS row_length, count(*)::BIGINT AS row_count, count(*) FILTER (c_custkey % 7 = 0)::BIGINT AS deleted_count FROM customer"),
    "bdat_variables": (bdat_variables, "SELECT * FROM (VALUES (0, 'c_custkey', 'NUMERIC', 0::BIGINT, 8, 0), (1, 'c_name', 'CHARACTER', 8, 25, 0), (2, 'c_nationkey', 'NUMERIC', 33, 8, 0), (3, 'c_acctbal', 'NUMERIC', 41, 8, 0), (4, 'c_mktsegment', 'CHARACTER', 49, 12, 0)) t(index, name, type, \"offset\", width, sort_order)"),
    "library_min_max": (library_min_max, "SELECT strftime(DATE '1960-01-01' + min(f)::INT, '%Y-%m-%d') AS created, strftime(DATE '1960-01-01' + max(f)::INT, '%Y-%m-%d') AS modified, count(*) AS members FROM (SELECT min(c_custkey) AS f FROM customer GROUP BY c_mktsegment)"),
    "sort_order_decode": (sort_order_decode, "SELECT o_orderkey, (CASE WHEN o_orderkey % 256 >= 128 THEN -(o_orderkey % 256 - 128) ELSE o_orderkey % 256 END)::INT AS sort_order FROM orders"),
    "variable_names_last": (variable_names_last, "SELECT lower(p_type) AS name, max(p_partkey) AS index FROM part GROUP BY 1"),
    "sas_date": (sas_date, "SELECT o_orderkey, date_diff('day', DATE '1960-01-01', o_orderdate)::DOUBLE AS sas_date FROM orders"),
    "sas_datetime": (sas_datetime, "SELECT event_id, round(epoch_us(ts) / 1e6 + 315619200, 6) AS sas_datetime FROM events"),
    "sas_time": (sas_time, TIME_SQL),
    "temporal_rejects": (temporal_rejects, REJECT_SQL),
    "iso_from_sas_datetime": (iso_from_sas_datetime, ISO_SQL),
    "iso_from_unix_datetime": (iso_from_unix_datetime, ISO_SQL),
    "iso_from_sas_date": (iso_from_sas_date, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"),
    "iso_from_unix_date": (iso_from_unix_date, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders"),
    "iso_from_sas_time": (iso_from_sas_time, ISO_TIME_SQL),
    "sas_timestamps": (sas_timestamps, "SELECT o_orderkey, strftime(TIMESTAMP '1960-01-01' + to_seconds(floor(o_orderkey * 86399.5 - 3e8)::BIGINT), '%Y-%m-%d %H:%M:%S') AS moment FROM orders"),
    "thousands_decimal": (thousands_decimal, "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders"),
    "thousands_reject": (thousands_reject, THOUSANDS_SQL),
    "buffer_long_missing": (buffer_long_missing, "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN -9223372036854775808 ELSE trunc(value * 10 - 5)::BIGINT END AS as_long, event_id % 4 < 2 AS missing, event_id % 4 < 2 AS nan_back FROM events"),
    "type_names": (type_names, "SELECT CASE p_partkey % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'double' WHEN 3 THEN 'datetime' WHEN 4 THEN 'other' ELSE 'uri' END AS kind, count(*) AS n FROM part GROUP BY 1"),
    "target_mapping": (target_mapping, "SELECT * FROM (VALUES ('datetime', 'integer', 86400::DOUBLE), ('date', 'integer', 1), ('time', 'integer', 3723), ('string', 'integer', 1234), ('decimal', 'decimal', 1234.5), ('float', 'decimal', 2.5), ('decimal', 'decimal', 'NaN'::DOUBLE)) t(kind, target, value)"),
    "unix_mapping": (unix_mapping, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS of_date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS of_datetime, date_diff('day', DATE '1970-01-01', o_orderdate) || '.0' AS of_string FROM orders"),
    "sas_datetime_regions": (sas_datetime_regions, "SELECT * FROM (VALUES " + ", ".join(f"('{x}', {'NULL' if n is None else n}::DOUBLE)" for x, n in REGIONS) + ") t(text, seconds)"),
    "encoding_lookup": (encoding_lookup, "SELECT code::INT AS code, charset, row_number() OVER (PARTITION BY lower(charset) ORDER BY CASE WHEN code > 127 THEN code - 256 ELSE code END) = 1 AS preferred FROM (VALUES " + ", ".join(f"({c}, '{n}')" for c, n in charsets.CHARSETS.items()) + ") t(code, charset)"),
    "header_texts": (header_texts, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text FROM events"),
}


def queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
