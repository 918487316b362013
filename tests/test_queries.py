"""Every registered query against its DuckDB statement, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from askgrid.queries import ORACLE, QUERIES
from askgrid.sources.staging import sweep
from tests.conftest import SF

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else round(v, 6)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    sweep(spark)  # each query stands alone: nothing that another one has staged is there
    got = QUERIES[name](spark, SF)
    if name in ROWS_ONLY:
        assert got.count() > 0
        return
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    wanted = sorted([tuple(plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall()], key=str)
    rows = sorted([tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()], key=str)
    assert rows == wanted


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and list(rows[0].asDict()) == ["p_brand", "n", "mean", "largest"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["guarded_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), IsNotNull(p_retailprice), GreaterThan(p_size,10)" in plan
    assert "p_brand" not in plan.split("ReadSchema")[1]
