"""Every query with SQL against DuckDB on the smallest tables, and no cartesian product in any plan."""

from __future__ import annotations

import math

import duckdb
import pytest

from siftline.plans import catalog as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, db, name):
    frame = q.QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    names = sorted(frame.columns)
    found = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    result = db.execute(q.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    assert found == sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in result.fetchall())
