"""Every registered core query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from proofmill.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _value(x):
    if isinstance(x, (float, Decimal)):
        return None if math.isnan(x) else f"{float(x):.6f}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.6f}"
    return str(list(x)) if isinstance(x, (list, tuple)) else str(x) if x is not None else None


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted(repr([_value(r[c]) for c in order]) for r in got.collect())
    b = sorted(repr([_value(r[columns.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert "stratum" in __spark_entry__.entry(spark).columns
    assert set(registry.queries()) <= set(__spark_entry__.queries())
