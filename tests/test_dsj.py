"""Dataset-JSON scans (A1-A28)."""

import gzip
import json
import zlib

import pytest

from petrel import metadata
from petrel.operators import tables
from petrel.sources import dsj


def head(columns, records=None, **more):
    out = {"datasetJSONCreationDateTime": "2025-01-01T00:00:00", "datasetJSONVersion": "1.1.0", "itemGroupOID": "IG.DM", "name": "DM", "label": "Demographics"}
    if records is not None:
        out["records"] = records
    return out | {"columns": [{"itemOID": f"IT.{n}", "name": n, "label": n, "dataType": t} for n, t in columns]} | more


DM = [("NAME", "string"), ("AGE", "integer")]
MIXED = [("STR", "string"), ("INT", "integer"), ("FLT", "float"), ("BOOL", "boolean"), ("NUL", "string")]
ROWS = [["hello", 42, 3.14, True, None], ["world", -1, 0.0, False, "present"]]


def put(path, meta, rows, nested=False, squeeze=None, tail=""):
    if nested:
        text = json.dumps(meta)[:-1] + ', "rows": ' + json.dumps(rows) + tail + "}"
    else:
        text = "\n".join([json.dumps(meta), *map(json.dumps, rows)]) + "\n" + tail
    raw = text.encode()
    path.write_bytes(squeeze(raw) if squeeze else raw)
    return str(path)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("squeeze", [None, gzip.compress, zlib.compress])
def test_a2_a6_containers(spark, tmp_path, nested, squeeze):
    path = put(tmp_path / "a.json", head(MIXED, 2), ROWS, nested, squeeze)
    want = [("hello", 42.0, 3.14, "true", None), ("world", -1.0, 0.0, "false", "present")]
    assert got(dsj.read_dsj(spark, path)) == want
    indexed = dsj.read_dsj(spark, path, row_index=True)
    assert [r._row_index for r in indexed.orderBy("_row_index").collect()] == [0, 1]


def test_a6_pretty_head(spark, tmp_path):
    path = tmp_path / "a.ndjson"
    path.write_text(json.dumps(head(DM, 2), indent=1) + "\n" + '["A", 1]\n\n["B", 2]\n')
    assert got(dsj.read_dsj(spark, str(path))) == [("A", 1.0), ("B", 2.0)]


def test_a7_big_integers(spark, tmp_path):
    path = put(tmp_path / "a.json", head([("V", "string")]), [[99999999999999999999], [9223372036854775807]], nested=True)
    assert got(dsj.read_dsj(spark, path)) == [("9223372036854775807",), ("99999999999999999999",)]


@pytest.mark.parametrize("missing", ["itemOID", "name", "label", "dataType"])
def test_a8_required_column_keys(tmp_path, missing):
    meta = head(DM)
    del meta["columns"][1][missing]
    with pytest.raises(ValueError, match=missing):
        dsj.read_head(put(tmp_path / "a.json", meta, []))


def test_a9_a16_a17_a18_head(tmp_path):
    late = '{"name": "DM", "rows": [], "columns": []}'
    (tmp_path / "l.json").write_text(late)
    with pytest.raises(ValueError, match="columns"):
        dsj.read_head(str(tmp_path / "l.json"))
    assert dsj.read_head(put(tmp_path / "a.json", head(DM), [])).records == -1
    assert dsj.read_head(put(tmp_path / "b.json", head(DM, "12"), [])).records == -1
    with pytest.raises(ValueError, match="records"):
        dsj.read_head(put(tmp_path / "c.json", head(DM, 18446744073709551611), []))
    meta = head(DM)
    meta["columns"][0]["length"] = 1 << 40
    with pytest.raises(ValueError, match="length"):
        dsj.read_head(put(tmp_path / "d.json", meta, []))
    assert dsj.read_head(put(tmp_path / "e.json", head(DM, sourceSystem="x"), [])).source_system is None
    with pytest.raises(ValueError, match="version"):
        dsj.read_head(put(tmp_path / "f.json", head(DM, sourceSystem={"name": "x"}), []))
    with pytest.raises(OSError, match="too short"):
        dsj.sniff(b"{")
    with pytest.raises(OSError):
        dsj.sniff(b"PK")
    with pytest.raises(ValueError):
        (tmp_path / "n.json").write_text('{"a": NaN}')
        dsj.read_head(str(tmp_path / "n.json"))


def test_a10_a11_after_rows(spark, tmp_path):
    path = put(tmp_path / "a.json", head(DM), [["A", 1]], nested=True, tail=', "more": 1')
    assert got(dsj.read_dsj(spark, path)) == [("A", 1.0)]
    twice = tmp_path / "b.json"
    twice.write_text(json.dumps(head(DM))[:-1] + ', "rows": [["A", 1]], "rows": [["B", 2]]}')
    with pytest.raises(Exception, match="already parsed"):
        dsj.read_dsj(spark, str(twice)).collect()


def test_a12_no_rows(spark, tmp_path):
    path = put(tmp_path / "a.json", head(DM, 0), [])
    df = dsj.read_dsj(spark, path)
    assert df.columns == ["NAME", "AGE"] and df.count() == 0


@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("rows", [[["A"]], [["A", 1, 2]]])
def test_a13_arity(spark, tmp_path, nested, rows):
    path = put(tmp_path / "a.json", head(DM), rows, nested)
    with pytest.raises(Exception, match="2 expected"):
        dsj.read_dsj(spark, path).collect()


@pytest.mark.parametrize("line", ['{"x": 1}', "]", '["A", 1] ["B", 2]', '["A", 1', "7"])
def test_a14_bad_rows(spark, tmp_path, line):
    path = tmp_path / "a.ndjson"
    path.write_text(json.dumps(head(DM)) + "\n" + line + "\n")
    with pytest.raises(Exception, match="not a row"):
        dsj.read_dsj(spark, str(path)).collect()


@pytest.mark.parametrize("nested", [False, True])
def test_a15_record_count(spark, tmp_path, nested):
    path = put(tmp_path / "a.json", head(DM, 3), [["A", 1], ["B", 2]], nested)
    with pytest.raises(ValueError, match="3 records declared, 2 found"):
        dsj.read_dsj(spark, path)
    assert dsj.read_dsj(spark, path, verify=False).count() == 2
    assert dsj.record_counts(spark, path).first() == ("DM", 3, 2, False)


def test_c3_strict_cells(spark, tmp_path):
    for bad in ("12", True):
        path = put(tmp_path / "a.json", head(DM), [["A", bad]])
        with pytest.raises(Exception, match="Invalid value"):
            dsj.read_dsj(spark, path).collect()
    assert got(dsj.read_dsj(spark, put(tmp_path / "b.json", head(DM), [["A", "12"]]), strict=False)) == [("A", 12.0)]
    assert got(dsj.read_dsj(spark, put(tmp_path / "c.json", head(DM), [["A", 3.7], ["B", None]]))) == [("A", 3.7), ("B", None)]


def test_a19_a23_splits_and_slices(spark, tmp_path):
    n = 5000
    path = put(tmp_path / "a.ndjson", head([("I", "integer")], n), [[i] for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = dsj.read_dsj(spark, path, row_index=True)
        assert df.rdd.getNumPartitions() > 2
        assert all(r._row_index == r.I for r in df.collect())
        assert [tuple(r) for r in tables.slices(df).orderBy("slice_index").collect()] == [(i, 1000 * i, 1000) for i in range(5)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metadata_and_targets(spark, tmp_path):
    meta = head([("D", "date"), ("T", "time")], 1, originator="me", sourceSystem={"name": "S", "version": "1"})
    meta["columns"][0] |= {"targetDataType": "integer", "keySequence": 1, "length": 10}
    path = put(tmp_path / "a.json", meta, [["1960-01-02", "01:02"]])
    assert got(dsj.read_dsj(spark, path, apply_targets=True)) == [(1.0, "01:02")]
    assert dsj.read_dsj(spark, path, columns=["T"]).columns == ["T"]
    t = metadata.dsj_tables(spark, path).first()
    assert (t.originator, t.source_system.name, t.records) == ("me", "S", 1)
    assert [r.key_sequence for r in metadata.dsj_columns(spark, path).collect()] == [1, -1]
    assert dsj.read_dsj(spark, path).schema["D"].metadata["keySequence"] == 1


def test_nested_cells_keep_their_json(spark, tmp_path):
    path = put(tmp_path / "a.json", head([("V", "string"), ("W", "decimal")], 1), [[{"a": [1, 2]}, "1,5"]])
    assert got(dsj.read_dsj(spark, path)) == [('{"a":[1,2]}', "1,5")]


def test_folder_of_one_layout(spark, tmp_path):
    put(tmp_path / "a.ndjson", head(DM, 1), [["A", 1]])
    put(tmp_path / "b.json", head(DM, 2), [["B", 2], ["C", 3]], nested=True)
    assert got(dsj.read_dsj(spark, str(tmp_path))) == [("A", 1.0), ("B", 2.0), ("C", 3.0)]
    put(tmp_path / "c.json", head([("OTHER", "string")], 0), [])
    with pytest.raises(ValueError, match="differ"):
        dsj.read_dsj(spark, str(tmp_path))


def test_key_rank_is_whole(spark, tmp_path):
    rows = [(i % 7, (i * 389) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    df = df.withMetadata("b", {"keySequence": 2}).withMetadata("a", {"sortOrder": -1})
    out = {r.key_rank: (r.a, r.b, r.c) for r in tables.key_ranked(df, str(tmp_path / "ranked")).collect()}
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [out[i + 1] for i in range(len(want))] == want and len(out) == len(rows)
    assert tables.key_ranked(df.limit(0), str(tmp_path / "none")).count() == 0


def test_folder_of_many_files(spark, tmp_path):
    """Hundreds of files are one plan; heads of several lines, names with blanks, and wrong counts among them."""
    import json

    meta = {"datasetJSONCreationDateTime": "2025-01-01T00:00:00", "datasetJSONVersion": "1.1.0", "itemGroupOID": "IG", "name": "T", "label": "t", "columns": [{"itemOID": "N", "name": "N", "label": "n", "dataType": "integer"}]}
    for i in range(300):
        rows = "\n".join(f"[{i * 10 + k}]" for k in range(i % 4))
        (tmp_path / f"a file {i}.ndjson").write_text(json.dumps(meta | {"records": i % 4, "fileOID": f"F{i}"}) + "\n" + rows)
    want = sorted(float(i * 10 + k) for i in range(300) for k in range(i % 4))
    df = dsj.read_dsj(spark, str(tmp_path))
    assert str(df._jdf.queryExecution().analyzed()).count("Union") == 0 and sorted(r.N for r in df.collect()) == want
    numbered = dsj.read_dsj(spark, str(tmp_path), row_index=True)
    assert all(r._row_index == r.N % 10 for r in numbered.collect())
    (tmp_path / "pretty.ndjson").write_text(json.dumps(meta | {"records": 2}, indent=1) + "\n[9001]\n[9002]\n")
    assert sorted(r.N for r in dsj.read_dsj(spark, str(tmp_path)).collect()) == [*want, 9001.0, 9002.0]
    assert dsj.record_counts(spark, str(tmp_path)).where("ok").count() == 301
    (tmp_path / "wrong.ndjson").write_text(json.dumps(meta | {"records": 5}) + "\n[1]\n")
    with pytest.raises(ValueError, match="wrong.ndjson: 5 records declared, 1 found"):
        dsj.read_dsj(spark, str(tmp_path))
