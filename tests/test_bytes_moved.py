"""What a stored registry shuffles and writes: narrow rows and no more than needed."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from bindery.operators import blobs as blob_ops, retention
from bindery.operators.chain import audit_feed, with_successor
from bindery.operators.route import corrupt
from bindery.plans import catalog, ingest as ingest_module, registry as registry_module, views
from bindery.plans.ingest import ingest
from bindery.plans.registry import Registry
from bindery.schemas import FILE_TYPES
from bindery.session import fresh_path, written

SF_DIR = "/root/testdata/sf0.001"


def stored(spark, batch_id="a"):
    reg = Registry(spark, fresh_path(spark, "registry"))
    ingest(reg, views.as_bundles(views.submissions(spark, SF_DIR)).where("seq < 300"), batch_id)
    return reg


def counted(df):
    return sorted(map(tuple, df.select("csi_id", "region", "regulation", "purged", "kept").collect()))


def test_clean_plans_with_narrow_rows(spark, monkeypatch):
    columns = {}

    def spy(df, label):
        columns[label] = set(df.columns)
        return written(df, label)

    reg = stored(spark)
    monkeypatch.setattr(registry_module, "written", spy)
    reg.clean(keep=1)
    assert {"report_id", "version", "active"} <= columns["plan"]
    assert not columns["marked"] & {"checksums", "file_contents", "original_files", "change"}
    assert not columns["plan"] & {"checksums", "file_contents", "original_files", "change"}


def test_purge_returns_the_counts_of_a_join(spark):
    reg = stored(spark)
    before = written(with_successor(reg.versions()), "before")
    plan = written(retention.purge_plan(before, 1), "plan")
    assert plan.count() > 0
    want = counted(retention.purge_counts(before, plan))
    assert counted(reg.purge(plan, dry_run=True)) == want
    refs = blob_ops.references(retention.survivors(before, plan)).groupBy("blob_id").count()
    assert counted(reg.purge(plan)) == want
    ledger = {tuple(r) for r in reg.ledger().where("refs > 0").collect()}
    assert ledger == {tuple(r) for r in refs.collect()}


def test_audit_entries_are_joined_only_after_a_break(spark, monkeypatch):
    on = []
    kind = type(spark.range(1))
    plain = kind.join

    def spy(self, other, keys=None, how=None):
        on.append(keys)
        return plain(self, other, keys, how)

    monkeypatch.setattr(kind, "join", spy)
    reg = stored(spark)
    entry = ["report_id", "version", "action"]
    assert entry not in on
    want = sorted(map(str, audit_feed(reg.versions()).select(*entry).collect()))
    assert sorted(map(str, reg.audit().select(*entry).collect())) == want
    reg._write_audit("a")  # as if it had broken off before its mark
    assert entry in on
    assert sorted(map(str, reg.audit().select(*entry).collect())) == want


def test_tables_are_compressed_and_sorted_within_folders(spark):
    reg = stored(spark)
    reg.clean(keep=1)
    for table in ("current", "versions", "audit", "outcomes", "blobs"):
        files = glob.glob(f"{reg.root}/{table}/**/*.parquet", recursive=True)
        groups = [g for f in files for g in [pq.read_metadata(f)] if g.num_rows]
        assert groups
        assert {g.row_group(0).column(0).compression for g in groups} == {"ZSTD"}
    for table in ("current", "versions"):
        for f in glob.glob(f"{reg.root}/{table}/**/*.parquet", recursive=True):
            ids = pq.ParquetFile(f).read(["report_id"])["report_id"].to_pylist()
            assert ids == sorted(ids)


def test_the_ledger_query_plans_with_narrow_rows(spark, monkeypatch):
    columns = {}

    def spy(df, label):
        columns[label] = set(df.columns)
        return written(df, label)

    monkeypatch.setattr(catalog, "written", spy)
    assert catalog.queries()["blob_ledger"](spark, SF_DIR).count() > 0
    assert {"report_id", "version", "active"} <= columns["plan"]
    assert not columns["plan"] & {"checksums", "file_contents", "original_files", "change"}


def test_bundles_are_searched_for_lost_files_only_if_a_version_lacks_one(spark, monkeypatch):
    asked = []

    def spy(bundles, active):
        asked.append(active)
        return corrupt(bundles, active)

    monkeypatch.setattr(ingest_module, "corrupt", spy)
    reg = stored(spark)
    more = views.as_bundles(views.submissions(spark, SF_DIR)).where("seq >= 300")
    ingest(reg, more, "b")
    assert not asked
    ids = [F.col(f"file_contents.{f}_id") for f in FILE_TYPES]
    ids[1] = F.lit(None).cast("string")
    names = [f"{f}_id" for f in FILE_TYPES]
    lost = F.struct(*[c.alias(n) for c, n in zip(ids, names, strict=True)])
    active = written(reg.active().withColumn("file_contents", lost), "active")
    checked = ingest_module._checked(more, "inline", False)
    want = {r.seq for r in corrupt(checked.where("valid"), active).collect()}
    judged = ingest_module._refuse_corrupt(checked, active)
    assert asked and want
    assert {r.seq for r in judged.where("error LIKE '%Corrupt record%'").collect()} == want
