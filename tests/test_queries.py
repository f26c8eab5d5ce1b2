"""Every registered query against its SQL, on the smallest tables, and the shape of its plan."""

import functools
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from demos import builds
from demos.relations import TABLES
from rollcall.operators import checks as K

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_build():
    """The build is the same for every report, so the tests make it once."""
    make, patched = builds.built, pytest.MonkeyPatch()

    @functools.cache
    def made(folder):
        return {name: df.cache() for name, df in make(latest[folder]).items()}

    latest = {}

    def built(t):
        latest[t.folder] = t
        return made(t.folder)

    patched.setattr(builds, "built", built)
    yield
    patched.undo()


def rows_of(columns, rows):
    def plain(value):
        return "nan" if isinstance(value, float) and math.isnan(value) else value

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    assert "RoundRobin" not in df._jdf.queryExecution().executedPlan().toString()
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


def test_ranked_texts_are_limited_before_the_shuffle(spark):
    plan = QUERIES["top_distinct_texts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["semi_join_total"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_every_declared_rule_finds_violations(spark):
    from demos.registry import Tables
    from rollcall.plans import reports

    got = {r["check"]: r["violations"] for r in QUERIES["every_declared_check"](spark, FOLDER).collect()}
    assert set(got) == set(reports.declared_checks(builds.broken(Tables(spark, FOLDER)))) and len(got) == 30
    assert all(n > 0 for n in got.values()), got
    tables = builds.broken(Tables(spark, FOLDER))
    assert {r["check"]: r["violations"] for r in K.run(reports.declared_checks(tables)).collect()} == got
    counted = K.run_rules(tables, reports.declared_rules())
    # One scan for each of the twelve tables.
    assert counted._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == len(tables) == 12
