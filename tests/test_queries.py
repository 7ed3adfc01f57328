"""Every query of the catalogue against DuckDB on the same tables, as the driver compares them."""

from __future__ import annotations

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from tessera import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value) if isinstance(value, (list, dict, datetime.date)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in plans.ORACLE_SQL:
        assert got
        return
    told = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert got == rows_of(told.columns, told.fetchall())


def test_every_event_belongs_to_a_repair_run(spark, duck):
    told = duck.sql("SELECT count(DISTINCT event_id // 6) FROM events").fetchall()[0][0]
    assert plans.QUERIES["repair_fold"](spark, SF).count() == told


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
