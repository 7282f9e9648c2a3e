"""Every registered query of the event log against its SQL in DuckDB, and the driver's contract."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from strandlog.plans import event_queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(event_queries.QUERIES))
def test_query(spark, duck, name):
    df = event_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    sql = event_queries.ORACLE_SQL[name]
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(repr([_plain(row[names.index(c)]) for c in columns]) for row in res.fetchall())
    assert got == want


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "global_position" in df.columns
    assert set(event_queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_are_the_ones_wanted(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    q = event_queries.QUERIES
    first = plan(q["filter_streams_and_types"](spark, SF))
    assert "TakeOrderedAndProject" in first and re.search(r"PushedFilters: \[[^]]*In\(event_type, \[click,view\]\)", first)
    for name in ("read_all_first_page", "filter_streams_and_types", "read_all_backwards_from_position", "events_page"):
        # below the page's limit nothing is numbered, and no payload is shuffled
        for exchange in re.findall(r"Exchange hashpartitioning\(([^\n]*)\n([^\n]*)", plan(q[name](spark, SF))):
            assert "data#" not in exchange[1] and "props#" not in exchange[1]
    assert "Window" not in plan(q["total_count"](spark, SF))  # revisions that nobody reads are not computed
    grouped = plan(q["grouped_all_newest"](spark, SF))
    assert "partial_max_by" in grouped
