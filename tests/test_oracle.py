"""Registered search queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as driver
from siftline.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))
    assert want


def test_whole_sort_in_order(spark, duck):
    want = duck.execute(ORACLE_SQL["sort_path_component"]).fetchall()
    assert len(want) == duck.execute("SELECT count(*) FROM documents").fetchone()[0] > 100
    assert [tuple(r) for r in QUERIES["sort_path_component"](spark, DIR).collect()] == want


def test_later_matches_of_a_line(spark):
    lines = QUERIES["vimgrep_columns"](spark, DIR).groupBy("path", "line_number").count()
    assert lines.where("count > 1").count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["path", "line_number", "line"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
