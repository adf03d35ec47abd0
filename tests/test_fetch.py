"""Lookups and pages on a small set of versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bindery.operators import fetch

AT = dt.datetime(2024, 1, 1)
SCHEMA = (
    "report_id string, csi_id string, region string, regulation string, name string,"
    " version int, uploaded_at timestamp_ntz, active boolean"
)


@pytest.fixture(scope="module")
def versions(spark):
    rows = [
        (f"r{i}", f"C{i % 7}", "EU" if i % 2 else "US", f"R{i % 3}", "n", v, AT, v == 2)
        for i in range(30)
        for v in (1, 2)
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def keys(df):
    return [tuple(r[c] for c in fetch.PAGE_ORDER) for r in df.collect()]


def test_empty_and_unknown_filters_do_not_filter(versions):
    got = fetch.matching(versions, {"region": "", "csi_id": None, "color": "x"}, False)
    assert got.count() == 60


def test_filters_are_joined_by_and(versions):
    got = fetch.matching(versions, {"region": "EU", "regulation": "R1"})
    want = [r for r in versions.collect() if r.active and r.region == "EU" and r.regulation == "R1"]
    assert got.count() == len(want) > 0


def test_pages_cover_everything_once(versions):
    pages = [fetch.page(versions, limit=8, skip=s)[0] for s in range(0, 32, 8)]
    rows = [k for p in pages for k in keys(p)]
    assert rows == sorted(rows) and len(set(rows)) == len(rows) == 30
    assert fetch.page(versions, limit=8)[1].first().total == 30


def test_keyset_page_equals_offset_page(versions):
    first, _ = fetch.page(versions, limit=11)
    last = first.collect()[-1].asDict()
    after = fetch.page_after(fetch.matching(versions), last, 11)
    assert keys(after) == keys(fetch.page(versions, limit=11, skip=11)[0])


def test_page_bounds(versions):
    assert fetch.page(versions, limit=0, skip=5)[0].count() == 25
    for bad in ({"limit": 1001}, {"skip": -1}):
        with pytest.raises(ValueError):
            fetch.page(versions, **bad)


def test_batch_lookup_reports_misses(spark, versions):
    asked = spark.createDataFrame([("r1",), ("r1",), ("nobody",)], "report_id string")
    got = {r.report_id: (r.found, r.version) for r in fetch.by_report_ids(versions, asked).collect()}
    assert got == {"r1": (True, 2), "nobody": (False, None)}


def test_version_lookup(spark, versions):
    asked = [("r1", 1), ("r1", None), ("r2", 9), ("nobody", None)]
    df = spark.createDataFrame(asked, "report_id string, version int")
    rows = fetch.by_report_version(versions, df).collect()
    got = {(r.report_id, r.asked_version): (r.found, r.version) for r in rows}
    assert got == {
        ("r1", 1): (True, 1), ("r1", None): (True, 2), ("r2", 9): (False, 9),
        ("nobody", None): (False, None),
    }


@pytest.mark.parametrize("skip", [0, 1, 437, 999, 5000])
def test_deep_page_equals_sorting(spark, skip):
    """With ties, null keys and rows that repeat the sort columns."""
    rows = spark.range(1000).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("C"), F.col("id") % 13)).alias("csi_id"),
        F.lit("EU").alias("region"), F.concat(F.lit("R"), F.col("id") % 3).alias("regulation"),
        F.sha1(F.col("id").cast("string")).alias("report_id"), (F.col("id") % 4).alias("version"),
    ).cache()
    want = rows.orderBy(*fetch.PAGE_ORDER).offset(skip).limit(50).collect()
    got = fetch.deep_page(rows, 50, skip, ranges=7)
    assert got.collect() == want
