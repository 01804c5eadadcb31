"""Every registered query against its SQL twin, on whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scanloom.plans.oracle import ORACLE
from scanloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def test_all_have_a_twin():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) > 65


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["order_by_severity", "scan_trend", "by_category", "rules_per_language", "history_top50"])
def test_order(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    key = {
        "order_by_severity": lambda r: ["Critical", "High", "Medium", "Low"].index(r.severity),
        "scan_trend": lambda r: 0,
        "by_category": lambda r: r.category,
        "rules_per_language": lambda r: (-r.rules, r.language),
        "history_top50": lambda r: tuple(-ord(c) for c in r.ts),
    }[name]
    assert [key(r) for r in rows] == sorted(key(r) for r in rows)
