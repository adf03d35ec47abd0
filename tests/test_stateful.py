"""Stateful stream routing: equal to the batch, from a registry, and across restarts."""

import json

import pytest
from pyspark.sql import functions as F
from test_registry import SF_DIR

from bindery.operators import integrity
from bindery.operators.facts import content_facts
from bindery.operators.route import route
from bindery.plans import views
from bindery.plans.ingest import apply_mixed, ingest
from bindery.plans.registry import Registry
from bindery.session import fresh_path
from bindery.sources import inline
from bindery.streaming import ingest as streaming, stateful
from bindery.streaming.stateful import start_stateful_route


@pytest.fixture(scope="module")
def bundles(spark):
    """Some keys null, so that they meet as equal."""
    rows = views.as_bundles(views.submissions(spark, SF_DIR))
    return rows.withColumn("region", F.when(F.col("seq") % 7 > 0, F.col("region"))).cache()


def rows_of(df):
    return sorted(map(str, df.select("seq", "status", "reason", "report_id", "version").collect()))


def push(spark, bundles, landing, target, checkpoint, active=None, batch_id="0"):
    inline.build_payload(bundles).write.mode("append").json(landing)
    requests = streaming.read_landing(spark, landing)
    start_stateful_route(requests, target, checkpoint, active, batch_id).awaitTermination()


def test_restarts_give_no_double(spark, bundles):
    landing, target, mark = (fresh_path(spark, n) for n in ("landing", "target", "mark"))
    for part in ("seq < 300", "seq >= 300 AND seq < 700", "seq >= 700"):
        push(spark, bundles.where(part), landing, target, mark)
    push(spark, bundles.where("false"), landing, target, mark)
    got = spark.read.parquet(target)
    assert got.count() == bundles.count()
    assert rows_of(got) == rows_of(route(content_facts(bundles)))


def test_state_begins_with_the_registry(spark, bundles):
    landing, target, mark = (fresh_path(spark, n) for n in ("landing", "target", "mark"))
    registry = Registry(spark, fresh_path(spark, "registry"))
    good = bundles.where("region IS NOT NULL")
    ingest(registry, good.where("seq < 300"), "a")
    active = registry.active().cache()
    later = good.where("seq >= 300")
    for part in ("seq < 600", "seq >= 600"):
        push(spark, later.where(part), landing, target, mark, active, "b")
    want = route(content_facts(later), active, "b")
    assert rows_of(spark.read.parquet(target)) == rows_of(want)


def test_mixed_batch_is_stored(spark, bundles):
    registry = Registry(spark, fresh_path(spark, "registry"))
    good = bundles.where("region IS NOT NULL")
    ingest(registry, good.where("seq < 200"), "a")
    asked = registry.active().orderBy("report_id").select(
        "report_id", F.col("original_files.json_config").alias("old")
    )
    asked = asked.limit(3).withColumn("seq", (F.crc32("report_id") % 1000 + 5000).cast("long"))
    text = F.lit('{"report":{"name":"moved"}}').cast("binary")
    patches = asked.select(
        "seq", "report_id", F.lit("patch_id").alias("kind"), F.lit("new.json").alias("json_name"),
        text.alias("json_content"), F.localtimestamp().alias("uploaded_at"),
    )
    rows = good.where("seq >= 200 AND seq < 260").withColumn("kind", F.lit("bundle"))
    rows = rows.unionByName(patches, allowMissingColumns=True)
    got = apply_mixed(registry, rows, "m")
    assert got.count() == rows.count() > 50 and got.where("status = 'failed'").isEmpty()
    moved = registry.active().where("original_files.json_config = 'new.json'")
    assert moved.count() == 3
    versions = registry.versions()
    assert integrity.broken_chains(versions).isEmpty()
    assert integrity.several_active_per_key(versions).isEmpty()
    stored = registry.blobs().select("blob_id")
    assert moved.join(stored, F.col("file_contents.json_config_id") == F.col("blob_id")).count() == 3
    again = apply_mixed(registry, rows, "m")
    assert again.count() == rows.count() and registry.versions().count() == versions.count()


def test_odd_keys_come_back_as_they_were(spark, bundles):
    """Names that JSON escapes, empty and null parts, in two portions."""
    odd = F.when(F.col("seq") % 2 == 0, 'a "b"\n\\c é').otherwise("")
    few = bundles.where("seq < 120").withColumns({"csi_id": F.lit("x"), "region": odd})
    few = few.withColumn("regulation", F.lit(None).cast("string"))
    landing, target, mark = (fresh_path(spark, n) for n in ("landing", "target", "mark"))
    for part in ("seq < 70", "seq >= 70"):
        push(spark, few.where(part), landing, target, mark)
    got, want = spark.read.parquet(target), route(content_facts(few))
    assert rows_of(got) == rows_of(want)
    key = ("seq", "csi_id", "region", "regulation", "json_name", "is_new_version")
    assert set(got.select(*key).collect()) == set(want.select(*key).collect())


def test_a_key_is_read_and_left_in_one_packed_column(monkeypatch):
    """Data frames of many columns for each key made up the time; long keys leave in packs."""
    monkeypatch.setattr(stateful, "PACKED_ROWS", 2)

    class Held:
        exists = False

        def update(self, value):
            self.value = value

    texts = ['{"seq":2,"own_id":"b","json_sum":"j"}', '{"seq":1,"own_id":"a","json_sum":"j","sql_sum":"s"}']
    texts += ['{"seq":3,"own_id":"c","json_sum":"j","sql_sum":"s"}']
    held = Held()
    frames = iter([stateful.pd.DataFrame({"bundle": texts})])
    out = list(stateful._routed_key(("x", None, "r", "c"), frames, held))
    assert [(*o.columns, len(o)) for o in out] == [("routed", 1), ("routed", 1)]
    made = [r for o in out for r in json.loads(o["routed"][0])]
    assert [(r["seq"], r["status"], r["version"]) for r in made] == [
        (1, "created", 1), (2, "updated", 2), (3, "skipped", 2)
    ]
    assert made[0]["region"] is None and held.value == ("a", 2, "j", "s", None)
