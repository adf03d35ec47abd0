"""Request bodies in files of their own and landed in a table: the same bundles."""

import os

import pytest
from pyspark.sql import functions as F
from test_registry import SF_DIR

from bindery.plans import catalog
from bindery.sources import inline

BODIES = {
    "body=0": '{"bundles":[{"csi_id":"A","region":"é\\n\\"x\\"","sql_file_content":"UQ=="},{"csi_id":"B"}]}',
    "body=1": '{"bundles":[{"region":null,"json_config_filename":"r.json"}]}',
    "body=2": '{"bundles":[]}',
    "body=3": '{"other":1}',
    "body=4": '{"bundles":[{"csi_id":',
}


def shown(rows, source):
    return sorted(map(str, rows.drop("seq").withColumn("source", source).collect()))


def test_landed_bodies_give_the_rows_of_single_files(spark, tmp_path):
    for name, text in BODIES.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "body.json").write_text(text, encoding="utf-8")
    single = inline.read_pushed(spark, f"{tmp_path}/*")
    table = f"{tmp_path}-landed"
    inline.land_bodies(spark.createDataFrame(list(BODIES.items()), "source string, value string"), table)
    landed = inline.read_pushed(spark, table, landed=True)
    place = F.regexp_extract("source", "body=[0-9]+", 0)
    assert shown(single, place) == shown(landed, F.col("source"))
    assert landed.count() == 3


def test_bodies_do_not_cost_a_file_each(spark, monkeypatch):
    folders = []
    land = inline.land_bodies
    monkeypatch.setattr(inline, "land_bodies", lambda b, f: (folders.append(f), land(b, f)))
    got = catalog.queries()["inline_requests"](spark, SF_DIR)
    bodies = got.select("body").distinct().count()
    files = [f for f in os.listdir(folders[0]) if f.endswith(".parquet")]
    assert bodies > 100 and len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["body=0", "body=1"])
def test_order_within_a_body_is_kept(spark, tmp_path, name):
    table = f"{tmp_path}/landed"
    inline.land_bodies(spark.createDataFrame([(name, BODIES[name])], "source string, value string"), table)
    rows = inline.read_pushed(spark, table, landed=True).orderBy("seq").collect()
    assert [r["index"] for r in rows] == list(range(len(rows)))
