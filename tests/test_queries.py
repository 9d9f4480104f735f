"""Every registered query beside its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from triage_spark.plans.views import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.registry() if entry.registry()[n][1]]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x).lower() if isinstance(x, bool) else str(x)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_twin_run(spark):
    for name, (_, sql) in entry.registry().items():
        if sql is None:
            assert entry.queries()[name](spark, SF).count() > 0
