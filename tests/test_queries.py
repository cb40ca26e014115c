"""Every query that has SQL is held against it on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = E.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    r = db.execute(E.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(tuple(norm(row[i]) for i in order) for row in r.fetchall())


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert E.entry(spark).columns == ["tok_table", "token", "rows", "n_nodes", "n_files"]
