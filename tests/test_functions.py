"""Value functions against published pairs (V1-V16, C1-C10)."""

import math

import pytest
from pyspark.sql import functions as F

from petrel.codecs import charsets
from petrel.functions import buffers, mapping, numeric, temporal


def values(spark, fn, cells, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_v1_sas_datetime(spark):
    pairs = [("1960-01-01T00:00:00", 0.0), ("1960-01-02T00:00:00", 86400.0), ("1960-01-01T00:00:00.25", 0.25), ("1960-01-01T01:00:00.75+01:00", 0.75), ("not-a-date", None), ("2025-06-15 10:30:00", None), ("2025-02-30T00:00:00", None), (None, None)]
    assert values(spark, temporal.sas_datetime, [a for a, _ in pairs]) == [b for _, b in pairs]
    same = values(spark, temporal.sas_datetime, ["2025-06-15T10:30:00", "2025-06-15T10:30:00Z", "2025-06-15T12:30:00+02:00", "2025-06-15T05:30:00-05:00"])
    assert len(set(same)) == 1 and same[0] is not None


def test_v2_sas_date(spark):
    pairs = [("1960-01-01", 0.0), ("1960-01-02", 1.0), ("2025-13-45", None), ("2025", None)]
    assert values(spark, temporal.sas_date, [a for a, _ in pairs]) == [b for _, b in pairs]
    assert len(set(values(spark, temporal.sas_date, ["2025-06-15", "2025-06-15Z", "2025-06-15+02:00"]))) == 1


def test_v3_sas_time(spark):
    pairs = [("01:02:03", 3723.0), ("01:02", 3720.0), ("12:34:56.789", 45296.789), ("25:99:99", None), ("00:30:00+02:00", 81000.0), ("22:30:00", 81000.0)]
    for got, (_, want) in zip(values(spark, temporal.sas_time, [a for a, _ in pairs]), pairs, strict=True):
        assert got == want or got == pytest.approx(want, abs=1e-9)


def test_v4_inverse(spark):
    nan, inf = float("nan"), float("inf")
    got = values(spark, temporal.iso_from_sas_datetime, [0.25, 1e-7, 0.9999999, -0.5, nan, inf, 1e17, None], "double")
    assert got == ["1960-01-01T00:00:00.25", "1960-01-01T00:00:00", "1960-01-01T00:00:01", "1959-12-31T23:59:59.5", None, None, None, None]
    assert values(spark, temporal.iso_from_sas_date, [0.0, 0.6, -365.0, 1e15, nan], "double") == ["1960-01-01", "1960-01-02", "1959-01-01", None, None]
    assert values(spark, temporal.iso_from_sas_time, [3723.0, 86400.0, -1.0, 3723.5], "double") == ["01:02:03", "00:00:00", "23:59:59", "01:02:03.5"]
    assert values(spark, temporal.iso_from_unix_date, [0.0], "double") == ["1970-01-01"]
    assert values(spark, temporal.iso_from_unix_datetime, [0.25], "double") == ["1970-01-01T00:00:00.25"]


def test_v5_v6_v7_numbers(spark):
    good = {"1,234.5": 1234.5, "1,234,567": 1234567.0, "-1,234": -1234.0, "0x1p3": 8.0, "12.5d": 12.5, ".5": 0.5, "1.": 1.0, "Infinity": math.inf}
    assert values(spark, numeric.decimal_value, list(good)) == list(good.values())
    bad = ["1,5", "1,23", "1,2345", "1.234,5", "0,123", "1,234.5,6", None, "inf", "nan", "", "abc"]
    assert all(math.isnan(x) for x in values(spark, numeric.decimal_value, bad))


def test_v14_ibm(spark):
    pairs = {"4110000000000000": 1.0, "C110000000000000": -1.0, "4210000000000000": 16.0, "4080000000000000": 0.5, "3E10000000000000": 2.0**-12, "413243F6A8885A00": 3.1415926535897825, "0000000000000000": 0.0, "2E00000000000000": None, "4100000000000000": None, "4110": 1.0}
    df = spark.createDataFrame([(bytearray.fromhex(x),) for x in pairs], "x binary")
    assert [r[0] for r in df.coalesce(1).select(numeric.ibm_double(F.col("x"))).collect()] == list(pairs.values())
    zero = spark.createDataFrame([(bytearray.fromhex("80" + "0" * 14),)], "x binary").select(numeric.ibm_double(F.col("x"))).first()[0]
    assert zero == 0.0 and math.copysign(1, zero) == -1
    with pytest.raises(Exception, match="zero mantissa"):
        spark.createDataFrame([(bytearray.fromhex("01" + "0" * 14),)], "x binary").select(numeric.ibm_double(F.col("x"))).collect()
    tags = spark.createDataFrame([(bytearray.fromhex("2E" + "0" * 14),), (bytearray.fromhex("5A" + "0" * 14),), (bytearray.fromhex("4110" + "0" * 12),)], "x binary")
    assert [r[0] for r in tags.coalesce(1).select(numeric.missing_tag(F.col("x"))).collect()] == [".", "Z", None]


def test_c_buffers(spark):
    nan = float("nan")
    assert values(spark, buffers.as_long, [1.9, -1.9, nan, None], "double") == [1, -1, buffers.LEAST_LONG, buffers.LEAST_LONG]
    assert values(spark, buffers.is_missing, [1.0, nan, None], "double") == [False, True, True]
    assert values(spark, buffers.number_or_error, ["1.5", None]) == [1.5, None]
    with pytest.raises(Exception, match="Invalid value"):
        values(spark, buffers.number_or_error, ["x"])
    assert [buffers.buffer_type(x) for x in ("integer", "Float", "double", "decimal", "boolean", "uri")] == ["double"] * 3 + ["string"] * 3


def test_v0_v12_mapping(spark, caplog):
    assert [mapping.parse_type(x) for x in ("STRING", "DateTime", "blob", None)] == ["string", "datetime", "other", "unknown"]
    assert mapping.target_mapper("date", "integer") is temporal.sas_date
    assert mapping.target_mapper("string", None)(3) == 3
    with caplog.at_level("WARNING"):
        assert mapping.target_mapper("string", "integer") is numeric.decimal_value
        assert mapping.target_mapper("date", "other-kind")(3) == 3
    assert len(caplog.records) == 2
    assert mapping.unix_inverse_mapper("date") is temporal.iso_from_unix_date
    assert mapping.inverse_mapper("time", "integer") is temporal.iso_from_sas_time


def test_v13_charsets():
    assert charsets.charset_of(20) == "UTF-8" and charsets.charset_of(-83) == "IBM037" and charsets.charset_of(1) is None
    assert charsets.code_of("ibm037") == 0xAD and charsets.code_of("utf-8") == 20 and charsets.code_of("none") is None
    assert len(charsets.CHARSETS) == 111
    assert charsets.python_codec("windows-1252") == "cp1252" and charsets.python_codec("x-MacRomania") == "mac-romanian"
    with pytest.raises(LookupError):
        charsets.python_codec("x-IBM942")


def test_x9_header_time(spark):
    got = values(spark, lambda c: F.date_format(temporal.header_timestamp(c, 2026), "yyyy-MM-dd HH:mm:ss"), ["16FEB26:10:07:55", "16feb27:10:07:55", "31DEC1999:00:00:00", "xx"])
    assert got == ["2026-02-16 10:07:55", "1927-02-16 10:07:55", "1999-12-31 00:00:00", None]
