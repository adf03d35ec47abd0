"""Time the headline queries; prints one JSON line.

The tables that lookups and exports read (the stored registry) are built first
and timed as queries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bindery.plans import catalog, views  # noqa: E402
from bindery.session import local_session  # noqa: E402

BUILD = {
    "build_versions": views.versions,
    "build_order_facts": views.order_facts,
    "build_patches": views.patches,
    "build_document_facts": views.document_facts,
    "build_document_versions": views.document_versions,
    "build_document_blobs": views.document_blobs,
}
HEADLINE = (
    "route_status", "version_chain", "carried_files", "route_snapshot", "route_documents",
    "route_chats", "create_only", "create_duplicates", "active_snapshot", "audit_log", "history",
    "patch_by_id", "patch_by_key", "validate_bundles", "batch_summary", "fetch_by_ids",
    "records_page", "records_json", "record_version", "purge_plan", "purge_by_age", "blob_gc",
    "check_chain", "blob_upload_plan", "export_verify", "export_decision", "export_files",
    "export_zip", "inline_decode", "payload_build", "manifest_explode", "stream_route",
)


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bindery-bench", **{"spark.ui.showConsoleProgress": "false"})
    spark.range(1000).selectExpr("sum(id)").collect()
    jobs = BUILD | {name: catalog.queries()[name] for name in HEADLINE}
    times = {name: round(run(spark, fn, sf_dir), 3) for name, fn in jobs.items()}
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
