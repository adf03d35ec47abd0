"""Retention and blob collection against brute force."""

import datetime as dt
import random

import models
import pytest
from pyspark.sql import functions as F

from bindery.operators import retention

SCHEMA = (
    "report_id string, csi_id string, region string, regulation string, version int,"
    " uploaded_at timestamp_ntz, active boolean,"
    " file_contents struct<json_config_id:string,sql_file_id:string,template_id:string>"
)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for rid in range(40):
        csi = "HOT" if rid < 20 else f"C{rid % 5}"
        length = rng.randrange(1, 9)
        for v in range(1, length + 1):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
            files = tuple(rng.choice((None, "x", "y", f"{rid}-{v}")) for _ in range(3))
            out.append((f"r{rid:02}", csi, "EU", "R", v, at, v == length, files))
    return out


@pytest.fixture(scope="module")
def versions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def dicts(rows):
    names = ("report_id", "csi_id", "region", "regulation", "version", "uploaded_at", "active")
    return [dict(zip(names, r)) for r in rows]


def ids(df):
    return {(r.report_id, r.version) for r in df.collect()}


@pytest.mark.parametrize("keep", [0, 1, 3, 22, 30])
def test_plan(versions, rows, keep):
    assert ids(retention.purge_plan(versions, keep)) == models.purge(dicts(rows), keep)


def test_plan_beyond_the_limit_of_the_rank_rule(spark, versions, rows):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        plan = retention.purge_plan(versions, 26)
        assert ids(plan) == models.purge(dicts(rows), 26)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_anchored_plan_covers_the_whole_group(spark, versions, rows):
    one = spark.createDataFrame([("r03",)], "report_id string")
    got = ids(retention.purge_plan(versions, 3, report_ids=one))
    hot = [r for r in dicts(rows) if r["csi_id"] == "HOT"]
    assert got == models.purge(hot, 3)


def test_record_scope_keeps_records_apart(versions, rows):
    alone = [dict(r, csi_id=r["report_id"]) for r in dicts(rows)]
    assert ids(retention.purge_plan(versions, 2, scope="record")) == models.purge(alone, 2)


def test_counts_add_up(versions, rows):
    plan = retention.purge_plan(versions, 4)
    counts = retention.purge_counts(versions, plan)
    total = retention.purge_totals(counts).first()
    assert total.total_purged == plan.count() and total.records_processed == 6
    assert counts.agg(F.sum(F.col("purged") + F.col("kept"))).first()[0] == len(rows)


def test_age_is_since_upload_and_strict(versions):
    as_of = F.lit("2024-02-20").cast("timestamp_ntz")
    cutoff = dt.datetime(2024, 2, 20) - dt.timedelta(days=30)
    got = retention.purge_by_age(versions, as_of, 30)
    want = {
        (r.report_id, r.version)
        for r in versions.collect()
        if not r.active and r.uploaded_at < cutoff
    }
    assert ids(got) == want


def test_shared_blobs_stay(versions):
    plan = retention.purge_plan(versions, 3)
    gone = ids(plan)
    purged, kept = set(), set()
    for r in versions.collect():
        side = purged if (r.report_id, r.version) in gone else kept
        side |= {b for b in r.file_contents if b}
    assert {r.blob_id for r in retention.blob_gc(versions, plan).collect()} == purged - kept
    unsafe = retention.blob_gc_unsafe(versions, plan)
    assert {r.blob_id for r in unsafe.collect()} == purged & kept
