"""Stored registry: batches, retries, patches, purges, export and streams."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from bindery.operators import batch, chain, export, integrity, retention
from bindery.operators.blobs import dangling, orphans
from bindery.operators.facts import content_facts, file_facts
from bindery.operators.route import route
from bindery.operators.validate import validate
from bindery.plans import views
from bindery.plans.ingest import (
    apply_patches,
    create_records,
    ingest,
    ingest_manifests,
    ingest_requests,
)
from bindery.plans.registry import Registry
from bindery.session import fresh_path, written
from bindery.sources import files, inline, manifests
from bindery.streaming import ingest as streaming

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bundles(spark):
    return views.as_bundles(views.submissions(spark, SF_DIR)).cache()


@pytest.fixture(scope="module")
def whole(spark, bundles):
    return {r.seq: (r.status, r.reason, r.version) for r in route(content_facts(bundles)).collect()}


@pytest.fixture(scope="module")
def registry(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 400"), "a")
    ingest(reg, bundles.where("seq >= 400"), "b")
    return reg


def outcomes(reg):
    rows = reg.outcomes().collect()
    return {r["index"]: (r.status, r.reason, r.version) for r in rows}


def state(reg):
    cols = ["report_id", "version", "change", "checksums.sql_file", "original_files.sql_file"]
    return sorted(map(str, reg.versions().select(*cols).collect()))


def test_batches_equal_one_pass(registry, whole):
    assert outcomes(registry) == whole


def test_same_batch_again_changes_nothing(registry, bundles):
    before = state(registry)
    ingest(registry, bundles.where("seq >= 400"), "b")
    assert state(registry) == before


def test_checks_hold(registry):
    versions = registry.versions()
    assert integrity.several_active_per_report(versions).isEmpty()
    assert integrity.several_active_per_key(versions).isEmpty()
    assert integrity.broken_chains(versions).isEmpty()
    assert dangling(versions, registry.blobs()).isEmpty()
    assert orphans(registry.blobs(), versions).isEmpty()


def test_contents_are_stored_once(registry):
    blobs = registry.blobs()
    assert blobs.count() == blobs.select("blob_id").distinct().count()


def test_batch_that_broke_off_leaves_only_orphans(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    extra = spark.createDataFrame([("sha256:x", "x")], "blob_id string, filename string")
    lone = extra.select(
        "blob_id", "filename", F.lit("t").alias("content_type"), F.lit(1).cast("long").alias("length"),
        F.localtimestamp().alias("upload_date"), F.col("blob_id").alias("checksum"),
        F.lit(b"x").alias("content"),
    )
    reg.append_blobs(lone, "broken")
    ingest(reg, bundles.where("seq < 50"), "next")
    assert [r.blob_id for r in orphans(reg.blobs(), reg.versions()).collect()] == ["sha256:x"]
    reg.collect_blobs()
    assert orphans(reg.blobs(), reg.versions()).isEmpty()
    assert dangling(reg.versions(), reg.blobs()).isEmpty()


def test_purge_and_blob_collection(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 300"), "a")
    ingest(reg, bundles.where("seq >= 300 AND seq < 600"), "b")
    current = chain.with_successor(reg.versions())
    plan = written(retention.purge_plan(current, 2), "plan")
    n, doomed = current.count(), plan.count()
    dry = reg.purge(plan, dry_run=True)
    assert dry.agg(F.sum("purged")).first()[0] == doomed and reg.versions().count() == n
    done = reg.purge(plan)
    assert done.agg(F.sum("purged")).first()[0] == doomed > 0
    assert reg.versions().count() == n - doomed
    reg.collect_blobs()
    assert orphans(reg.blobs(), reg.versions()).isEmpty()
    assert dangling(reg.versions(), reg.blobs()).isEmpty()
    # The same rule again finds nothing; all inactive versions are old enough.
    assert reg.clean(keep=2).agg(F.sum("purged")).first()[0] == 0
    idle = reg.versions().count() - reg.active().count()
    assert reg.clean(max_age_days=90, dry_run=True).agg(F.sum("purged")).first()[0] == idle
    # Life goes on: later batches continue the chains that were cut short.
    ingest(reg, bundles.where("seq >= 600"), "c")
    assert integrity.broken_chains(reg.versions()).isEmpty()


def test_patches_are_stored(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 100"), "a")
    one = reg.active().orderBy("report_id").select("report_id").limit(1)
    code = F.base64(F.lit(b"SELECT patched"))
    none = F.lit(None).cast("string")
    request = one.select(
        F.lit(0).cast("long").alias("seq"), "report_id",
        none.alias("json_config_filename"), none.alias("json_config_content"),
        F.lit("p.sql").alias("sql_file_filename"), code.alias("sql_file_content"),
        none.alias("template_filename"), none.alias("template_content"),
    )
    at = F.lit("2024-03-01").cast("timestamp_ntz")
    patches = inline.decode_patches(request).withColumn("uploaded_at", at)
    row = apply_patches(reg, patches, "p").first()
    assert (row.status, row.changed) == ("updated", "sql_file")
    now = reg.active().where(F.col("report_id") == row.report_id).first()
    assert now.version == row.version and now.original_files.sql_file == "p.sql"
    stored = reg.blobs().where(F.col("blob_id") == now.file_contents.sql_file_id).first()
    assert bytes(stored.content) == b"SELECT patched"
    assert stored.content_type == "application/sql"


def test_patches_by_key_are_stored(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 100"), "a")
    n = reg.versions().count()
    some = bundles.where("seq >= 100 AND seq < 300").drop("name")
    got = apply_patches(reg, some, "p", by_key=True)
    held = reg.active(before="p").select(
        "csi_id", "region", "regulation", F.col("original_files.json_config").alias("json_name")
    )
    found = some.join(held, held.columns, "left_semi").count()
    assert 0 < found < 200 and got.count() == 200
    assert got.where("status = 'updated'").count() == found
    assert reg.versions().count() == n + found
    assert all("No active record found for csi_id=" in r.error
               for r in got.where("status = 'failed'").collect())
    assert dangling(reg.versions(), reg.blobs()).isEmpty()
    assert integrity.broken_chains(reg.versions()).isEmpty()


def test_create_refuses_taken_keys(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    first = create_records(reg, bundles.where("seq < 200"), "a")
    made = first.where("status = 'created'").count()
    assert made == bundles.where("seq < 200").select(
        "csi_id", "region", "regulation", "json_name").distinct().count() == reg.versions().count()
    assert made + first.where("error LIKE 'An active record already exists%'").count() == 200
    again = create_records(reg, bundles.where("seq < 200"), "b")
    assert again.where("status = 'failed'").count() == 200
    assert reg.versions().count() == made


def test_export_to_folder_and_zip(spark, registry, tmp_path):
    versions = registry.active().limit(5)
    manifest = export.export_manifest(versions, registry.blobs())
    out = export.exported_files(manifest, registry.blobs())
    paths = [r.path for r in export.write_folder(out, str(tmp_path)).collect()]
    assert len(paths) == manifest.count() and all(os.path.getsize(p) for p in paths)
    again = [r.path for r in export.write_folder(out, str(tmp_path)).collect()]
    assert sorted(again) == sorted(paths) == sorted(
        str(p) for p in tmp_path.rglob("*") if p.is_file()
    )
    for row in export.zips(out).collect():
        with zipfile.ZipFile(io.BytesIO(row.zip)) as archive:
            folder = tmp_path / row.report_id / f"v{row.version}"
            assert {n: archive.read(n) for n in archive.namelist()} == {
                p.name: p.read_bytes() for p in folder.iterdir()
            }
            assert row.n_files == len(archive.namelist())


def test_damaged_file_breaks_off_an_export_unless_forced(spark, registry):
    versions = registry.active().limit(1)
    blobs = registry.blobs().withColumn("content", F.lit(b"other"))
    manifest = export.export_manifest(versions, blobs)
    assert export.export_decision(manifest).first().report_status == "aborted"
    assert export.exported_files(manifest, blobs).isEmpty()
    assert export.export_decision(manifest, force=True).first().report_status == "forced"
    assert export.exported_files(manifest, blobs, force=True).count() == manifest.count()


def test_lost_file_is_an_error_and_no_abort(spark, registry):
    manifest = export.export_manifest(registry.active().limit(1), registry.blobs().limit(0))
    row = export.export_decision(manifest).first()
    assert row.report_status == "exported" and row.n_files == 0 and row.n_errors >= 2


def test_stream_equals_batch(spark, bundles, whole):
    landing, checkpoint = fresh_path(spark, "landing"), fresh_path(spark, "stream")
    reg = Registry(spark, fresh_path(spark, "registry"))
    payload = inline.build_payload(bundles)
    for part in ("seq < 300", "seq >= 300 AND seq < 700", "seq >= 700"):
        payload.where(part).write.mode("append").json(landing)
        requests = streaming.read_landing(spark, landing)
        streaming.start_ingest(requests, reg, checkpoint).awaitTermination()
    assert outcomes(reg) == whole
    feed = fresh_path(spark, "audit")
    streaming.start_audit_feed(reg, feed, fresh_path(spark, "check")).awaitTermination()
    got = spark.read.parquet(feed)
    want = chain.audit_feed(reg.versions())
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_undecodable_request_fails_alone(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    payload = inline.build_payload(bundles.where("seq < 10")).withColumn(
        "sql_file_content", F.when(F.col("seq") == 4, "A").otherwise(F.col("sql_file_content"))
    )
    got = ingest_requests(reg, payload, "x")
    bad = got.where("status = 'failed'").collect()
    assert [(r["index"], r.error, r.reason) for r in bad] == [
        (4, "Cannot decode sql_file", "Processing error")
    ]
    assert tuple(batch.summary(got).first())[3:] == (1, 10)


def test_manifest_files_end_to_end(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "a.json").write_text('{"report": {"name": "A"}}')
    (tmp_path / "q.sql").write_text("SELECT 1")
    (tmp_path / "t.txt").write_text("hello {region}")
    (tmp_path / "empty.sql").write_text("")
    (tmp_path / "seed.yaml").write_text(
        """
bundles:
  - {csi_id: C1, region: EU, regulation: R, json_config: configs/a.json, sql_file: q.sql,
     template: t.txt}
  - {csi_id: C2, region: EU, regulation: R, json_config: configs/a.json, sql_file: empty.sql}
  - not a mapping
  - {csi_id: C3, region: EU, regulation: R, json_config: ./configs/a.json, sql_file: q.sql}
"""
    )
    (tmp_path / "broken.yaml").write_text("bundles: [")
    (tmp_path / "null.yaml").write_text("bundles:")
    (tmp_path / "none.yaml").write_text("other: 1")
    (tmp_path / "list.yaml").write_text("- 1")
    found = manifests.read_yaml(spark, str(tmp_path)).cache()
    errors = {os.path.basename(r.source): r.parse_error for r in found.collect()}
    assert errors["seed.yaml"] is None and errors["broken.yaml"].startswith("Failed to parse")
    assert errors["list.yaml"] == "YAML root must be a mapping, got list"
    assert errors["null.yaml"] == "'bundles' must be a YAML list, got null"
    assert errors["none.yaml"] == "missing required top-level key 'bundles'"
    entries = manifests.entries(found.where("parse_error IS NULL"))
    on_disk = files.read_files(spark, str(tmp_path))
    attached = files.attach(entries, file_facts(on_disk))
    checked = validate(attached).cache()
    got = {r["index"]: (r.valid, r.error) for r in checked.collect()}
    assert got[0][0] and got[3][0]
    assert "SQL file not found: empty.sql" in got[1][1]
    assert got[2][1] == "Bundle #2: must be a mapping/dict"
    reg = Registry(spark, fresh_path(spark, "registry"))
    out = ingest_manifests(reg, entries, on_disk, "m").orderBy("position").collect()
    assert [(r["index"], r.label, r.status) for r in out] == [
        (1, "C2", "failed"), (2, "bundle-2", "failed"), (0, "C1", "created"), (3, "C3", "created"),
    ]
    rows = {r.csi_id: r for r in reg.active().collect()}
    assert (rows["C1"].original_files.json_config, rows["C1"].name) == ("a.json", "A")
    assert (rows["C1"].file_sizes.template, rows["C3"].file_sizes.template) == (14, None)
    assert {bytes(b.content) for b in reg.blobs().collect()} == {
        b'{"report": {"name": "A"}}', b"SELECT 1", b"hello {region}",
    }
    whole = ingest_manifests(reg, entries, on_disk, "w", manifests_read=found)
    bad = [r.error for r in whole.where("index IS NULL").collect()]
    assert len(bad) == 4 and all(e for e in bad)
    # The same manifest again finds nothing to do.
    again = ingest_manifests(reg, entries, on_disk, "n")
    assert {r.status for r in again.collect()} == {"failed", "skipped"}


def test_json_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"bundles": [{"csi_id": "C", "region": "EU", "regulation": "R",\n'
        ' "json_config": "a.json", "sql_file": "q.sql"}, null]}'
    )
    rows = manifests.entries(manifests.read_json(spark, str(tmp_path))).orderBy("index").collect()
    assert [(r["index"], r.is_mapping, r.csi_id) for r in rows] == [(0, True, "C"), (1, False, None)]


def test_repeated_numbers_of_clients_store_nothing_wrong(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    payload = inline.build_payload(bundles.where("seq < 12"))
    seq = F.when(F.col("seq") < 4, 0).when(F.col("seq") < 6, None).otherwise(F.col("seq"))
    got = ingest_requests(reg, payload.withColumn("seq", seq.cast("long")), "x").collect()
    assert sorted(r.status for r in got if r.error) == ["failed"] * 6 and len(got) == 12
    blobs = reg.blobs()
    wrong = blobs.where(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("checksum"))
    assert wrong.isEmpty() and dangling(reg.versions(), blobs).isEmpty()


def test_null_keys_are_refused(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    payload = inline.build_payload(bundles.where("seq < 9"))
    region = F.when(F.col("seq") % 3 != 0, F.col("region"))
    got = ingest_requests(reg, payload.withColumn("region", region), "x").collect()
    bad = {r["index"]: r.error for r in got if r.status == "failed"}
    assert set(bad) == {0, 3, 6} and all("missing required field 'region'" in e for e in bad.values())
    assert reg.versions().where("region IS NULL").isEmpty()


def test_another_input_under_a_known_batch_is_refused(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 20"), "a")
    before = state(reg)
    with pytest.raises(ValueError, match="another input"):
        ingest(reg, bundles.where("seq < 21"), "a")
    for name in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError, match="not usable"):
            ingest(reg, bundles.where("seq < 20"), name)
    assert state(reg) == before


def test_two_streams_into_one_registry(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    payload = inline.build_payload(bundles)
    for part in ("seq < 10", "seq >= 10 AND seq < 20"):
        landing = fresh_path(spark, "landing")
        payload.where(part).write.json(landing)
        requests = streaming.read_landing(spark, landing)
        streaming.start_ingest(requests, reg, fresh_path(spark, "stream")).awaitTermination()
    assert reg.outcomes().count() == 20


def test_audit_feed_goes_on_after_a_purge(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    feed, mark = fresh_path(spark, "feed"), fresh_path(spark, "mark")
    ingest(reg, bundles.where("seq < 200"), "a")
    streaming.start_audit_feed(reg, feed, mark).awaitTermination()
    reg.clean(keep=1)
    ingest(reg, bundles.where("seq >= 200 AND seq < 260"), "b")
    streaming.start_audit_feed(reg, feed, mark).awaitTermination()
    got = spark.read.parquet(feed)
    assert got.count() == got.distinct().count() == reg.audit().count() > 260


def test_dead_blobs_do_not_come_back(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 300"), "a")
    before = reg.blobs().count()
    reg.clean(keep=1)
    reg.collect_blobs()
    assert 0 < reg.blobs().count() < before
    ingest(reg, bundles.where("seq >= 300"), "b")
    assert dangling(reg.versions(), reg.blobs()).isEmpty()
    other = Registry(spark, fresh_path(spark, "compact"))
    reg.compact_blobs(other)
    same = lambda r: sorted(x.blob_id for x in r.blobs().select("blob_id").collect())
    assert same(other) == same(reg)


def test_patches_with_flaws_fail_whole(spark, bundles):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, bundles.where("seq < 60"), "a")
    ids = [r.report_id for r in reg.active().orderBy("report_id").limit(3).collect()]
    good = F.base64(F.lit(b"SELECT 2"))
    rows = spark.createDataFrame([(0, ids[0]), (1, None), (2, ids[1]), (3, ids[2])], "seq long, report_id string")
    request = rows.select(
        "seq", "report_id",
        F.when(F.col("seq") == 3, "other.json").alias("json_config_filename"),
        F.lit(None).cast("string").alias("json_config_content"),
        F.lit("q.sql").alias("sql_file_filename"),
        F.when(F.col("seq") == 0, F.lit("A")).otherwise(good).alias("sql_file_content"),
        F.lit("t.txt").alias("template_filename"), good.alias("template_content"),
    )
    before = reg.versions().count()
    got = {r["index"]: r for r in apply_patches(reg, inline.decode_patches(request), "p").collect()}
    assert [got[i].status for i in range(4)] == ["failed", "failed", "updated", "updated"]
    assert got[0].error == "Cannot decode sql_file"
    assert reg.versions().count() == before + 2
    assert reg.versions().where("report_id IS NULL").isEmpty()


def test_manifest_ids_do_not_depend_on_partitions(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"report": {"name": "A"}}')
    (tmp_path / "q.sql").write_text("SELECT 1")
    rows = [
        (f"m{m}", [{"csi_id": f"C{m}-{i}", "region": "EU", "regulation": "R",
                    "json_config": str(tmp_path / "a.json"), "sql_file": str(tmp_path / "q.sql")}
                   for i in range(4)])
        for m in range(6)
    ]
    found = spark.createDataFrame(rows, manifests.MANIFEST)
    on_disk = files.read_files(spark, str(tmp_path))
    ids = []
    for n in (1, 7):
        reg = Registry(spark, fresh_path(spark, "registry"))
        ingest_manifests(reg, manifests.entries(found.repartition(n)), on_disk, "m")
        ids.append({r.csi_id: r.report_id for r in reg.versions().collect()})
    assert ids[0] == ids[1]


def test_types_of_manifest_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"bundles": [{"csi_id": 12, "region": true, "regulation": "R", "json_config": ["x"],'
        ' "sql_file": "q.sql"}, 5]}'
    )
    (tmp_path / "b.json").write_text('{"bundles": {"x": 1}}')
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text("{")
    (tmp_path / "e.json").write_text('{"bundles": null}')
    found = manifests.read_json(spark, str(tmp_path)).cache()
    errors = {os.path.basename(r.source): r.parse_error for r in found.collect()}
    assert errors == {
        "a.json": None, "b.json": "'bundles' must be a YAML list, got dict",
        "c.json": "YAML root must be a mapping, got list",
        "d.json": "Failed to parse YAML manifest: not valid JSON",
        "e.json": "'bundles' must be a YAML list, got null",
    }
    rows = validate(manifests.entries(found), layers=("fields",)).orderBy("index").collect()
    said = "'csi_id' must be a string, got int; 'region' must be a string, got bool; "
    assert said + "'json_config' must be a string, got list" in rows[0].error
    assert rows[1].error == "Bundle #1: must be a mapping/dict"


def test_paths_that_climb(spark):
    rows = spark.createDataFrame(
        [("/m/a/b/seed.yaml", "../../x.sql", "/m/x.sql"), ("/m/seed.yaml", "c/../d/./e.sql", "/m/d/e.sql"),
         ("file:///m/seed.yaml", "q.sql", "/m/q.sql")],
        "source string, path string, want string",
    )
    got = rows.select(files.resolve(F.col("source"), F.col("path")).alias("p"), "want").collect()
    assert all(r.p == r.want for r in got)


@pytest.mark.parametrize("between", ["batch", "purge"])
def test_ended_batch_run_again_changes_nothing(spark, bundles, between):
    reg = Registry(spark, fresh_path(spark, "registry"))
    feed, mark = fresh_path(spark, "feed"), fresh_path(spark, "mark")
    first = bundles.where("seq < 200")
    ingest(reg, first, "a")
    if between == "batch":
        ingest(reg, bundles.where("seq >= 200 AND seq < 300"), "b")
    else:
        reg.clean(keep=1)
    before, audit = state(reg), reg.audit().count()
    streaming.start_audit_feed(reg, feed, mark).awaitTermination()
    again = ingest(reg, first, "a")
    assert again.count() == 200 and state(reg) == before
    streaming.start_audit_feed(reg, feed, mark).awaitTermination()
    got = spark.read.parquet(feed)
    assert got.count() == got.distinct().count() == audit == reg.audit().count()


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["append_outcomes", "append_versions", "end", "_write_audit"])
def test_batch_that_broke_off_is_done_once(spark, bundles, step):
    """Wherever it breaks off, and with another batch in between."""

    def fail(*args, **kwargs):
        raise Broken

    reg = Registry(spark, fresh_path(spark, "registry"))
    feed, mark = fresh_path(spark, "feed"), fresh_path(spark, "mark")
    ingest(reg, bundles.where("seq < 30"), "a")
    with pytest.MonkeyPatch.context() as patch, pytest.raises(Broken):
        patch.setattr(Registry, step, fail)
        ingest(reg, bundles.where("seq >= 30 AND seq < 60"), "b")
    ended = step == "_write_audit"
    assert reg.outcomes().count() == (60 if ended else 30)
    ingest(reg, bundles.where("seq >= 60 AND seq < 90"), "c")
    streaming.start_audit_feed(reg, feed, mark).awaitTermination()
    ingest(reg, bundles.where("seq >= 30 AND seq < 60"), "b")
    streaming.start_audit_feed(reg, feed, mark).awaitTermination()
    assert reg.outcomes().count() == 90
    assert integrity.broken_chains(reg.versions()).isEmpty()
    got, want = spark.read.parquet(feed), chain.audit_feed(reg.versions())
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
