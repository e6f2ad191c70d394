"""Sources: transport files, SAS7BDAT, codecs (X*, B*)."""

import numpy as np
import pytest

from petrel import metadata
from petrel.codecs import ibm, rdc, rle
from petrel.operators import tables
from petrel.sources import sas7bdat
from petrel.testing import encoders as E


def write(path, data):
    path.write_bytes(data)
    return str(path)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_b25_rdc_bytes():
    assert rdc.decompress(bytes.fromhex("1000414243F000"), 18) == b"ABC" * 6
    assert len(rdc.decompress(bytes.fromhex("1000414243200000"), 19)) == 19
    with pytest.raises(ValueError):
        rdc.decompress(bytes.fromhex("1000414243F000"), 19)


def test_b26_rle_controls():
    cases = [(b"\x82abc", b"abc"), (b"\xc0A", b"AAA"), (b"\xd0", b"@@"), (b"\xe1", b"   "), (b"\xf0", b"\0\0"), (b"\x40\x00B", b"B" * 18), (b"\x50\x01", b"@" * 18), (b"\x60\x00", b" " * 17), (b"\x70\x00", b"\0" * 17), (b"\x00\x01" + b"x" * 65, b"x" * 65), (b"\x10\x00" + b"y" * 4160, b"y" * 4160)]
    for packed, plain in cases:
        assert rle.decompress(packed, len(plain)) == plain
    for bad in (b"\x20\x00", b"\x30", b"\x85a"):
        with pytest.raises(ValueError):
            rle.decompress(bad, 10)


@pytest.mark.parametrize("method", ["rle", "rdc"])
def test_codecs_round_trip(method):
    rng = np.random.default_rng(3)
    squeeze, expand = (E.rle_compress, rle.decompress) if method == "rle" else (E.rdc_compress, rdc.decompress)
    for _ in range(60):
        row = b"".join(bytes([rng.choice([32, 0, 64, 65, 66])]) * int(rng.integers(1, 400)) for _ in range(8)) + rng.integers(0, 256, int(rng.integers(0, 200)), dtype=np.uint8).tobytes()
        assert expand(squeeze(row), len(row)) == row


def test_x6_ibm_bulk():
    v = np.random.default_rng(1).normal(size=500) * 10.0 ** np.arange(-25, 25).repeat(10)
    assert (ibm.decode(E.numeric_cells(v))[0] == v).all()
    assert ibm.decode(E.numeric_cells([float("nan")]))[1].tolist() == [True]
    with pytest.raises(ValueError):
        ibm.decode(np.array([[1, 0, 0]], np.uint8))


FIRST = [("VAL1", E.numeric_cells([1, 2, 3, 4, 5]), True), ("VAL2", E.numeric_cells([10.5, -20.25, 0, 1e6, -0.125]), True)]
THIRD = [("TXT", E.char_cells(["alpha", "beta", "gamma", "delta"], 5), False)]


def test_x1_members(spark, tmp_path):
    path = write(tmp_path / "three.xpt", E.xpt_file([E.xpt_member("FIRST", FIRST), E.xpt_member("THIRD", THIRD)]))
    load = lambda **o: spark.read.format("xpt").options(**o).load(path)
    assert rows_of(load()) == [(1.0, 10.5), (2.0, -20.25), (3.0, 0.0), (4.0, 1e6), (5.0, -0.125)]
    assert rows_of(load(member="THIRD")) == [("alpha",), ("beta",), ("gamma",), ("delta",)]
    assert rows_of(load(firstMemberOnly="true")) == rows_of(load())
    assert load(columns="VAL2").columns == ["VAL2"]
    assert rows_of(load(partitionBytes="16")) == rows_of(load())
    with pytest.raises(Exception, match="no member"):
        load(member="NONE").collect()
    assert [r.name for r in metadata.xpt_members(spark, path).collect()] == ["FIRST", "THIRD"]
    assert metadata.xpt_library(spark, path).first().members == 2


def test_x5_ends(spark, tmp_path):
    text = lambda values, w: [("T", E.char_cells(values, w), False)]
    one = E.xpt_file([E.xpt_member("M", text(["a" * 20, "b" * 20], 20))])
    assert spark.read.format("xpt").load(write(tmp_path / "a.xpt", one)).count() == 2
    # A look-alike that is only a prefix of the tag is data.
    look = E.xpt_file([E.xpt_member("M", text(["HEADER RECORD", "x"], 30))])
    assert rows_of(spark.read.format("xpt").load(write(tmp_path / "b.xpt", look))) == [("HEADER RECORD",), ("x",)]
    # An all-blank frame ends the member; as padding only trailing ones do.
    blank = write(tmp_path / "c.xpt", E.xpt_file([E.xpt_member("M", text(["a", "", "b"], 20))]))
    assert rows_of(spark.read.format("xpt").load(blank)) == [("a",)]
    assert rows_of(spark.read.format("xpt").option("blankFrame", "padding").load(blank)) == [("a",), ("",), ("b",)]
    # Eight cells of 30 bytes are three whole records: cut inside an observation.
    cut = E.xpt_file([E.xpt_member("M", text(["a" * 30] * 8, 30))])[:-10]
    with pytest.raises(Exception, match="Truncated"):
        spark.read.format("xpt").load(write(tmp_path / "d.xpt", cut)).collect()
    with pytest.raises(Exception, match="not a version 5"):
        spark.read.format("xpt").load(write(tmp_path / "e.xpt", b"x" * 400)).collect()


TAG = b"HEADER RECORD*******"


@pytest.mark.parametrize("blank", ["end", "padding"])
@pytest.mark.parametrize(("width", "data", "want"), [
    (20, b"A" * 20 + TAG, ["A" * 20]),  # the tag fills an observation
    (25, b"A" * 25 + b" " * 5 + TAG, ["A" * 25]),  # the tag fills the rest of one
    (30, b"A" * 30 + b" " * 20 + TAG + b" " * 60, ["A" * 30]),  # the tag is split over two
    (7, b"A" * 7 + TAG + b"B" * 29, ["A" * 7]),  # over many
    (25, b"A" * 25 + b"HEADER RECORD**HELLO12345", ["A" * 25, "HEADER RECORD**HELLO12345"]),  # no whole tag
    (30, b"A" * 30 + b" " * 20 + b"HEADER REC" + b"B" * 30, ["A" * 30, " " * 20 + "HEADER REC", "B" * 30]),  # nor one
    (30, b"A" * 25 + TAG[:5] + TAG[5:] + b"C" * 15, ["A" * 25 + "HEADE", "R RECORD*******" + "C" * 15]),  # not after blanks
    (30, b"A" * 30 + b" " * 50, ["A" * 30]),  # a short blank rest
])
def test_x5_tags(spark, tmp_path, width, data, want, blank):
    whole = E.xpt_file([E.xpt_member("M", [("T", E.char_cells(["z" * width], width), False)])])
    head = whole[: whole.index(b"z" * width)]
    path = write(tmp_path / "a.xpt", head + data)
    df = spark.read.format("xpt").option("blankFrame", blank).load(path)
    assert [r.T for r in df.collect()] == want


def test_x5_truncated_and_one_member(spark, tmp_path):
    whole = E.xpt_file([E.xpt_member("M", [("T", E.char_cells(["z" * 30], 30), False)])])
    head = whole[: whole.index(b"z" * 30)]
    with pytest.raises(Exception, match="Truncated"):
        spark.read.format("xpt").load(write(tmp_path / "a.xpt", head + b"A" * 30 + b"B" * 12)).collect()
    path = write(tmp_path / "b.xpt", head + b"A" * 60 + b" " * 20)
    load = spark.read.format("xpt").option("blankFrame", "padding").option("oneMember", "true")
    assert load.load(path).count() == 2


def test_cells_in_bulk():
    from petrel.codecs.cells import texts

    plain = lambda cells, enc, trim: [(bytes(c).rstrip(b" \0") if trim else bytes(c)).decode(enc) for c in cells]
    for enc, words in (("utf-8", ["é x", "", "日本", " a\0"]), ("iso8859-1", ["é x", "", "abc ", "\0"]), ("cp1252", ["plain", "text"]), ("cp037", ["ABC", "x y"]), ("shift_jis", ["日本", "a\\b"])):
        raw = [w.encode(enc) for w in words]
        pad = " ".encode(enc)
        cells = np.frombuffer(b"".join(x + pad * (12 - len(x)) for x in raw), np.uint8).reshape(len(raw), 12)
        for trim in (True, False):
            assert texts(cells, enc, trim).to_pylist() == plain(cells, enc, trim)
    assert texts(np.zeros((0, 4), np.uint8), "utf-8").to_pylist() == []


def table(n=500):
    rng = np.random.default_rng(5)
    return np.arange(n, dtype=float), rng.normal(size=n), [f"row {i} é" for i in range(n)]


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("little", [True, False])
@pytest.mark.parametrize("method", ["", "SASYZCRL", "SASYZCR2"])
def test_b_layouts_and_twins(tmp_path, wide, little, method):
    ids, vals, txt = table()
    gone = np.arange(len(ids)) % 7 == 0
    columns = [{"name": "id", "numeric": True, "sort": 1}, {"name": "val", "numeric": True, "sort": 0x82, "label": "Value"}, {"name": "txt", "numeric": False}]
    data = E.sas7bdat_file(columns, [E.float_cells(ids, little, 5), E.float_cells(vals, little), E.char_cells(txt, 40)], wide=wide, little=little, compression=method, deleted=gone, label="A set")
    h = sas7bdat.parse_dataset(write(tmp_path / "a.sas7bdat", data))
    sas7bdat.verify_rows(h)
    assert (h.compression, h.label, h.row_count, h.deleted, [c.sort_order for c in h.columns], h.columns[1].label) == (method, "A set", 500, int(gone.sum()), [1, -2, 0], "Value")
    got = []
    with sas7bdat.Reader(h.uri) as f:
        for k in range(h.page_count):
            rows, marks = sas7bdat.page_rows(h, f.at(h.header_size + k * h.page_size, h.page_size))
            if len(rows):
                got += list(zip(*(sas7bdat.decode_column(h, c, rows[~marks], "utf-8", "nan").to_pylist() for c in h.columns), strict=True))
    assert got == [(a, b, c) for a, b, c, d in zip(ids, vals, txt, gone, strict=True) if not d]


def test_b22_bitmap():
    h = sas7bdat.Header("", True, True, "", 20, "", "", None, None, 0, 1000, 1, row_length=21)
    page = sas7bdat.Page("MIXED2", 8, [], 40)
    raw = bytearray(1000)
    raw[100 + 8 * 21 + 40] = 0x51
    assert sas7bdat.deleted_rows(h, page, bytes(raw), 100, 8).astype(int).tolist() == [0, 1, 0, 1, 0, 0, 0, 1]


def test_b30_fully_deleted_page(spark, tmp_path):
    ids, vals, txt = table(2000)
    gone = np.arange(2000) < 700
    data = E.sas7bdat_file([{"name": "id", "numeric": True}, {"name": "t", "numeric": False}], [E.float_cells(ids), E.char_cells(txt, 60)], deleted=gone, page_size=8192)
    path = write(tmp_path / "a.sas7bdat", data)
    df = spark.read.format("sas7bdat").option("partitionBytes", "8192").load(path)
    assert sorted(r.id for r in df.collect()) == list(range(700, 2000))
    marked = spark.read.format("sas7bdat").option("includeDeleted", "true").load(path)
    assert tables.deleted_count(marked).first() == (700, 2000) and tables.live_rows(marked).count() == 1300


def test_b_errors_and_missing(spark, tmp_path):
    data = E.sas7bdat_file([{"name": "x", "numeric": True}], [E.float_cells([1.0, float("nan")])])
    path = write(tmp_path / "a.sas7bdat", data)
    got = spark.read.format("sas7bdat").load(path).collect()
    assert got[0].x == 1.0 and np.isnan(got[1].x)
    assert spark.read.format("sas7bdat").option("missing", "null").load(path).collect()[1].x is None
    with pytest.raises(Exception, match="truncated|whole"):
        spark.read.format("sas7bdat").load(write(tmp_path / "b.sas7bdat", data[:-100])).collect()
    with pytest.raises(Exception, match="not a SAS7BDAT"):
        spark.read.format("sas7bdat").load(write(tmp_path / "c.sas7bdat", b"x" * 5000)).collect()


def test_b1_b2_folder(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"m{i}.sas7bdat", E.sas7bdat_file([{"name": "x", "numeric": True, "sort": 0x81}], [E.float_cells([i])], name=f"M{i}", created=86400.0 * i))
    (tmp_path / "other.txt").write_text("no")
    df = spark.read.format("sas7bdat").load(str(tmp_path))
    assert sorted(r.x for r in df.collect()) == [0, 1, 2]
    lib = metadata.bdat_library(spark, str(tmp_path)).first()
    assert (str(lib.created)[:10], str(lib.modified)[:10], lib.members) == ("1960-01-01", "1960-01-03", 3)
    assert [r.x for r in df.orderBy(*tables.key_order(df)).collect()] == [2, 1, 0]
