"""The contract's functions, and queries held against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in contract.oracle_sql() if not n.startswith(("op", "pipeline"))]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    cell = lambda v: "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["ts", "severity", "source", "message"] and got.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = plain(contract.queries()[name](spark, DATA).toPandas())
    assert got == plain(duck.sql(contract.oracle_sql()[name]).df())


def test_whole_tables(duck):
    """No bound keeps the streams' queries from the end of the table."""
    last = duck.sql("select max(epoch_us(ts)) * 1000 from events").fetchall()[0][0]
    for name, column in (("stream_ingest", "ts"), ("stream_late_drop", "ts"), ("stream_dedup", "ts"), ("stream_hourly", "hour_start"), ("transfer_keeps_all", "ts"), ("chunk_accept", "ts")):
        assert duck.sql(f"select max({column}) from ({contract.oracle_sql()[name]})").fetchall()[0][0] >= last - 24 * 3_600_000_000_000
