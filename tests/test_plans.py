"""Guards on physical plans: what reaches the scan, what is shuffled."""

import re

from bindery.operators import blobs as blob_ops, chain, export, fetch, retention
from bindery.operators.facts import content_facts
from bindery.operators.route import route
from bindery.plans import views

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routing_takes_one_shuffle_and_one_sort(spark):
    facts = views.document_facts(spark, SF_DIR)
    text = plan(route(facts))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_routing_never_reads_contents_again(spark):
    text = plan(route(views.document_facts(spark, SF_DIR)))
    assert "sql_content" not in text and "sql_text" not in text


def test_facts_need_no_shuffle(spark):
    text = plan(content_facts(views.as_bundles(views.document_bundles(spark, SF_DIR))))
    assert "Exchange" not in text


def test_lookups_push_their_filters_to_all_scans(spark):
    rows = fetch.matching(views.current(spark, SF_DIR), {"csi_id": "CSI-0001"}, False)
    text = plan(rows)
    assert text.count("EqualTo(csi_id,CSI-0001)") == text.count("FileScan parquet") == 3


def test_lookups_by_id_cut_the_registry_first(spark):
    versions = views.versions(spark, SF_DIR)
    asked = versions.select("report_id").limit(3)
    text = plan(chain.with_successor(fetch.of_reports(versions, asked)))
    scans = text.count("FileScan parquet")
    assert text.count("LeftSemi") >= 3 and scans <= 6


def test_reading_blobs_does_not_shuffle_the_contents_of_others(spark):
    blobs = views.document_blobs(spark, SF_DIR)
    text = plan(blob_ops.read_blobs(blobs, blobs.select("blob_id").limit(2)))
    for line in text.splitlines():
        if "Exchange" in line:
            assert "content#" not in line


def test_audit_feed_needs_no_shuffle(spark):
    assert "Exchange" not in plan(chain.audit_feed(views.versions(spark, SF_DIR)))


def test_retention_limits_groups_before_the_shuffle(spark):
    text = plan(retention.purge_plan(views.current(spark, SF_DIR), 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_verification_reads_contents_only_to_hash_them(spark):
    versions = views.document_versions(spark, SF_DIR)
    text = plan(export.export_manifest(versions, views.document_blobs(spark, SF_DIR)))
    for line in text.splitlines():
        if "Exchange" in line or "Join" in line:
            assert "content#" not in line
