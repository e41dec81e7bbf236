"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from flowloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE:
        assert got
        return
    cur = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_pair_series_has_every_pair(spark, tmp_path):
    """Users 255 and 511 get addresses that end in 255."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i * 30) AS ts, [7, 255, 511][1 + i % 3] AS user_id,
      ['error', 'view', 'click'][1 + (i // 3) % 3] AS event_type, i * 1.5 AS value, '{"k": ' || i % 5 || '}' AS props FROM range(40) t(i)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    key = ("src", "dst", "starts", "bytes_out", "bytes_in")
    got = sorted(tuple(plain(r[c]) for c in key) for r in catalogue.QUERIES["pair_series"](spark, str(tmp_path)).collect())
    want = sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(key)} FROM ({catalogue.ORACLE['pair_series']})").fetchall())
    assert got == want and any(r[1].endswith(".255") for r in got)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
