"""Every registered query of the reference operators against DuckDB on the same tables."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from tessella.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [[_plain(r[c]) for c in sorted(df.columns)] for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(df.columns)]
    want = [[_plain(r[i]) for i in at] for r in cur.fetchall()]
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_human_sizes_of_large_and_null_keys(spark, tmp_path):
    """Keys beyond those of the test tables: sizes over a PiB, which the SQL gives in TiB, halves, and none."""
    keys = [0, 1, 32, 999, 150_001, 1_200_781, 3_000_002, 8_999_999, 35_999_999, 91_999_999, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r["id"], r["size"]) for r in QUERIES["human_sizes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["human_sizes"]).fetchall()) and (1_200_781, "1024.2 TiB") in got and (None, None) in got
