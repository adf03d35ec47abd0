"""Every registered query against its SQL on the same tables."""

import datetime as dt
import math
import os
from pathlib import Path

import duckdb
import pytest

from bindery.plans import catalog, oracles

SF_DIR = os.environ.get("BINDERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_plain(r[i]) for i in order) for r in rows
    )


# Types of the two engines that stand for each other.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE",
}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got_cols, got = _table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    described = result.description
    want_cols, want = _table([c[0] for c in described], result.fetchall())
    assert got_cols == want_cols
    want_types = {c[0]: str(c[1]) for c in described}
    assert {c: TYPES[t] for c, t in df.dtypes} == want_types
    assert got, "an empty result checks nothing"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        pytest.fail(f"{len(got)} rows, expected {len(want)}\nextra {extra}\nmissing {missing}")
