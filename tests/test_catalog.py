"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from petrel.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null" if x is None else "nan"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(cell(v) for v in r) for r in df.select(*columns).collect())
    assert found
    sql = catalog.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert found == sorted(tuple(cell(r[i]) for i in order) for r in cur.fetchall())


def test_sas_timestamps_of_far_years(spark, tmp_path):
    """Keys whose moments lie on both sides of the years 0 and 10000, and a null one."""
    keys = [None, 0, -679000, -707500, -708000, -712000, -713000, -714000, -716163, -800000, -5000000, 2940039, 2940040, 8999999, 100000000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {tuple(r) for r in catalog.queries()["sas_timestamps"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert found == set(con.execute(catalog.oracle_sql()["sas_timestamps"]).fetchall())
    assert {(2940039, "9999-12-31 18:19:40"), (2940040, "10000-01-01 18:19:40"), (-714000, "-5-08-21 21:50:00"), (None, None)} < found


def test_sas_timestamps_are_whole_seconds(spark, tmp_path):
    """Beyond 2**59 microseconds the SQL's span, a double, comes 64 microseconds short of odd seconds; the query stays exact."""
    spark.createDataFrame([(6675517,), (6675518,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {tuple(r) for r in catalog.queries()["sas_timestamps"](spark, str(tmp_path)).collect()}
    exact = "SELECT k, strftime(TIMESTAMP '1960-01-01' + to_microseconds((k::BIGINT * 172799 // 2 - 300000000) * 1000000), '%Y-%m-%d %H:%M:%S') FROM (VALUES (6675517), (6675518)) t(k)"
    assert found == set(duckdb.sql(exact).fetchall()) == {(6675517, "20227-05-02 03:30:41"), (6675518, "20227-05-03 03:30:41")}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_in(folder) -> set[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    return set(out.stdout.splitlines()[0].split())


def test_optional_part_may_be_missing(tmp_path):
    """A copy without the training-data folders, and one without the pipeline alone."""
    whole = tmp_path / "copy"
    shutil.copytree(ROOT, whole, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt"))
    operators = sorted(f.name for f in whole.glob("petrel/llm"))
    (whole / "corpus_pipeline.py").unlink(missing_ok=True)
    assert len(names_in(whole) - set(catalog.QUERIES)) == (10 if operators else 0)
    shutil.rmtree(whole / "petrel/llm", ignore_errors=True)
    assert names_in(whole) == set(catalog.QUERIES)
