"""Mixed batches against a sequential model, with keys given up and taken again."""

import datetime as dt
import importlib
import random

import models
import pytest
from pyspark.sql import functions as F, types as T
from test_routing import bundle, frame

from bindery.functions import fingerprint as fp
from bindery.operators.chain import active_versions
from bindery.operators.integrity import several_active_per_key
from bindery.operators.mixed import mixed, mixed_versions
from bindery.operators.route import route, version_rows
from bindery.schemas import KEY3, KEY4

NOW = dt.datetime(2024, 2, 1)
FIELDS = [f"{s}_{c}" for s in ("json", "sql", "tpl") for c in ("name", "sum")]
SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("kind", "report_id", *KEY3, *FIELDS, "name")]
)


@pytest.fixture(scope="module")
def registry(spark):
    rows = [bundle(i, csi=f"C{i % 3}", tpl="x" if i % 2 else None, json_name=f"r{i // 3}.json")
            for i in range(9)]
    active = active_versions(version_rows(route(frame(spark, rows)))).cache()
    records = {
        r.report_id: {
            "key3": (r.csi_id, r.region, r.regulation), "version": r.version, "name": r.name,
            "json_name": r.original_files.json_config, "sql_name": r.original_files.sql_file,
            "tpl_name": r.original_files.template, "json_sum": r.checksums.json_config,
            "sql_sum": r.checksums.sql_file, "tpl_sum": r.checksums.template,
        }
        for r in active.collect()
    }
    return active, records


def run(spark, rows, active, segment_rows=1_000_000):
    df = spark.createDataFrame([tuple(r[c] for c in SCHEMA.names) for r in rows], SCHEMA)
    sizes = {f"{s}_size": F.length(f"{s}_sum").cast("long") for s in ("json", "sql", "tpl")}
    df = df.withColumns(sizes | {"uploaded_at": F.lit(NOW).cast("timestamp_ntz")})
    return mixed(df.repartition(4), active, "x", segment_rows)


def own_ids(spark, rows):
    """Report ids that bundles get if they create."""
    some = [(r["seq"], *(r[k] for k in KEY4)) for r in rows if r["kind"] == "bundle"]
    df = spark.createDataFrame(some, "seq long, " + ", ".join(f"{k} string" for k in KEY4))
    return dict(df.select("seq", fp.report_id(KEY4, "x", "seq")).collect())


def make(rng, seq, records, names):
    row = dict.fromkeys(SCHEMA.names)
    csi = f"C{rng.randrange(3)}"
    kind = rng.choice(["bundle", "bundle", "patch_id", "patch_id", "patch_id", "patch_key"])
    row |= {"seq": seq, "kind": kind}
    rid = rng.choice([*sorted(records), "nobody"])
    if kind == "patch_id":
        row["report_id"] = rid
    else:
        row |= dict(zip(KEY3, next(iter(records.values()))["key3"], strict=True)) | {"csi_id": csi}
    for s in ("json", "sql", "tpl"):
        if kind == "bundle" and s != "tpl" or rng.random() < 0.5 or s == "json" and kind != "patch_id":
            row |= {f"{s}_name": f"{s}{seq}", f"{s}_sum": f"sum{rng.randrange(3)}"}
    if row["json_sum"]:
        row |= {"json_name": f"r{rng.randrange(names)}.json", "name": f"name{seq}"}
    return row


def compare(spark, registry, rows, segment_rows=1_000_000):
    active, records = registry
    ids = own_ids(spark, rows)
    for r in rows:
        r["own"] = ids.get(r["seq"])
    want = models.mixed(rows, records)
    df = run(spark, rows, active, segment_rows).cache()
    got = {}
    for r in df.collect():
        state = (r.report_id, r.version, r.name, r.json_name, r.json_sum, r.sql_name, r.sql_sum,
                 r.tpl_name, r.tpl_sum)
        got[r.seq] = (r.status, state if r.status != "failed" else None)
    assert got == want
    return df, want


@pytest.mark.parametrize("seed,names,segment_rows", [(1, 4, 1_000_000), (2, 6, 1_000_000), (3, 4, 9)])
def test_random_interleavings_equal_sequential_model(spark, registry, seed, names, segment_rows):
    rng = random.Random(seed)
    rows = [make(rng, seq, registry[1], names) for seq in range(120)]
    # some patches name records that the batch itself creates
    ids = own_ids(spark, rows)
    for r in rows:
        if r["kind"] == "patch_id" and rng.random() < 0.3:
            r["report_id"] = ids[rng.choice(sorted(ids))]
    df, want = compare(spark, registry, rows, segment_rows)
    statuses = [s for s, _ in want.values()]
    assert {"created", "updated", "failed"} <= set(statuses)
    left = mixed_versions(df).unionByName(registry[0])
    assert several_active_per_key(active_versions(left)).isEmpty()
    assert left.count() == left.select("report_id", "version").distinct().count()


def test_keys_given_up_and_taken_again(spark, registry):
    """a -> b, b' -> a's key, back and forth; a bundle creates where a key is free."""
    active, records = registry
    a, b, c = sorted(
        (i for i, r in records.items() if r["key3"][0] == "C0"), key=lambda i: records[i]["json_name"]
    )
    none = dict.fromkeys(SCHEMA.names)
    key3 = dict(zip(KEY3, records[a]["key3"], strict=True))

    def move(seq, rid, name):
        return none | {"seq": seq, "kind": "patch_id", "report_id": rid, "json_name": name,
                       "json_sum": f"j{seq}", "name": f"n{seq}"}

    def put(seq, name):
        return none | key3 | {"seq": seq, "kind": "bundle", "json_name": name, "json_sum": "j",
                              "sql_name": "s", "sql_sum": f"s{seq}", "name": "n"}

    rows = [
        move(0, a, "r1.json"), move(1, a, "free.json"), move(2, b, "r0.json"), put(3, "r1.json"),
        move(4, c, "r1.json"), move(5, b, "r0.json"), move(6, a, "r0.json"), put(7, "free.json"),
        move(8, b, "other.json"), move(9, a, "r0.json"), put(10, "free.json"), move(11, c, "free.json"),
    ]
    _, want = compare(spark, registry, rows)
    assert [want[i][0] for i in range(12)] == [
        "failed", "updated", "updated", "created", "failed", "updated", "failed", "updated",
        "updated", "updated", "created", "failed",
    ]


def test_without_moves_it_is_routing(spark, registry):
    rows = [bundle(i, csi=f"C{i % 5}", sql=f"s{i % 4}") for i in range(40)]
    rows = frame(spark, rows)
    as_mixed = rows.withColumns(
        {"kind": F.lit("bundle"), "report_id": F.lit(None).cast("string")}
    )
    got = mixed(as_mixed, registry[0], "x")
    want = route(rows, registry[0], "x")
    columns = ["seq", "status", "reason", "report_id", "version", "changed"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_later_rounds_hold_only_groups_that_still_change(spark, registry, monkeypatch):
    """One group whose moves hang on each other, and one that the first round settles."""
    active, records = registry
    first, second, _ = sorted(
        (i for i, r in records.items() if r["key3"][0] == "C0"), key=lambda i: records[i]["json_name"]
    )
    calm = next(i for i, r in records.items() if r["key3"][0] == "C1")
    moves = [(first, records[second]["json_name"]), (second, records[first]["json_name"]),
             (second, "new.json"), (first, records[second]["json_name"])]
    moves += [(calm, f"free{k}.json") for k in range(30)]
    rows = [
        dict.fromkeys(SCHEMA.names)
        | {"seq": seq, "kind": "patch_id", "report_id": rid, "json_name": name,
           "json_sum": f"j{seq}", "name": f"n{seq}"}
        for seq, (rid, name) in enumerate(moves)
    ]
    module, sizes = importlib.import_module("bindery.operators.mixed"), []
    keep = module.written

    def counting(df, label):
        stored = keep(df, label)
        if label == "owned":
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(module, "written", counting)
    compare(spark, registry, rows)
    *rounds, _ = sizes
    assert len(rounds) > 1 and rounds[0] > 60 and max(rounds[1:]) < 20
