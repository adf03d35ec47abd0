"""Checks layer by layer, and the two ways of reading a config."""

import pytest
from pyspark.sql import functions as F

from bindery.functions import fingerprint as fp, text
from bindery.operators.batch import details, errors, summary
from bindery.operators.facts import content_facts
from bindery.operators.validate import validate, validate_manifests
from bindery.operators.route import route

GOOD = b'{"report":{"name":"N"}}'
COLS = ("csi_id", "region", "regulation", "json_config", "sql_file", "template",
        "json_content", "sql_content", "tpl_content")
SCHEMA = ", ".join(f"{c} {'binary' if c.endswith('content') else 'string'}" for c in COLS)


def check(spark, profile="manifest", strict=False, **change):
    row = dict(zip(COLS, ("C", "EU", "R", "a.json", "q.sql", None, GOOD, b"SELECT 1", None)))
    df = spark.createDataFrame([tuple((row | change).values())], SCHEMA)
    df = df.withColumn("index", F.lit(3))
    return validate(content_facts(df, strict), profile).first()


@pytest.mark.parametrize(
    "change, says",
    [
        ({}, None),
        ({"csi_id": None, "region": " \t"},
         "Bundle #3 (csi_id=?): validation failed — missing required key 'csi_id'; "
         "'region' must not be blank"),
        ({"csi_id": "a b"}, "'csi_id' contains invalid characters"),
        ({"csi_id": " a.b-c_1 "}, None),
        ({"region": "EU "}, None),
        ({"region": "é"}, "'region' contains invalid characters"),
        ({"json_content": None}, "JSON config not found: a.json"),
        ({"sql_content": b""}, "SQL file is empty (0 bytes): q.sql"),
        ({"template": "t.txt"}, "Template not found: t.txt"),
        ({"template": ""}, None),
        ({"sql_file": "d.x/.sql"}, "SQL file must have extension {'.sql'}, got ''"),
        ({"sql_file": "Q.SQL"}, None),
        ({"template": "t.pdf", "tpl_content": b"x"}, "Template file extension '.pdf' is not in"),
        ({"sql_content": b"\xff\xfe"}, "SQL file is not valid UTF-8: q.sql"),
        ({"sql_content": "  \x1c\n".encode()}, "SQL file contains only whitespace: q.sql"),
        ({"json_config": "a.txt"}, "JSON config must be a .json file, got: '.txt'"),
        ({"json_content": b"\xff"}, "JSON config file is not valid UTF-8: a.json"),
        ({"json_content": b"nope"}, "Invalid JSON in a.json"),
        ({"json_content": b"[1]"}, "JSON config root must be a JSON object"),
        ({"json_content": b"{}"}, "missing required 'report' object"),
        ({"json_content": b'{"report":[]}'}, "missing required 'report' object"),
        ({"json_content": b'{"report":{}}'}, "missing required field 'report.name'"),
        ({"json_content": b'{"report":{"name":5}}'}, "missing required field 'report.name'"),
        ({"json_content": b'{"report":{"name":" "}}'}, "missing required field 'report.name'"),
    ],
)
@pytest.mark.parametrize("strict", [False, True])
def test_first_error(spark, change, says, strict):
    row = check(spark, strict=strict, **change)
    assert row.valid == (says is None)
    assert says is None or says in row.error
    assert row.error == (row.errors[0] if row.errors else None)


def test_all_errors_are_listed_in_layer_order(spark):
    row = check(spark, csi_id="a b", sql_file="q.txt", sql_content=b" ", json_content=b"[]")
    found = [e.split(": ", 1)[1].split(" ")[0] for e in row.errors]
    assert found == ["'csi_id'", "SQL", "SQL", "JSON"]


@pytest.mark.parametrize(
    "content, valid",
    [
        (b'{"report":{"name":"x"},"n":NaN}', True),
        (b'{"report":{"name":"x","name":"y"}}', True),
        (b'{"report":{"name":"x"}} rest', False),
        (b"{'report':{'name':'x'}}", False),
        (b'\xef\xbb\xbf{"report":{"name":"x"}}', False),
    ],
)
def test_strict_reading_of_rare_configs(spark, content, valid):
    assert check(spark, strict=True, json_content=content).valid == valid


def test_profiles_apply_fewer_layers(spark):
    odd = {"csi_id": "a b", "sql_file": "q.txt"}
    assert check(spark, "inline", **odd).valid
    assert not check(spark, "inline", sql_content=b" ").valid
    assert check(spark, "create", sql_content=b" ", **odd).valid
    assert not check(spark, "create", json_content=b"x").valid


def test_manifest_structure(spark):
    rows = [("a", None), ("b", []), ("c", [("x",)])]
    df = spark.createDataFrame(rows, "source string, bundles array<struct<csi_id:string>>")
    got = {r.source: r.error for r in validate_manifests(df).collect()}
    assert got["a"] == "a: missing required top-level key 'bundles'"
    assert got["b"] == "b: 'bundles' list is empty — nothing to seed"
    assert got["c"] is None


def test_one_bad_bundle_does_not_stop_the_rest(spark):
    rows = [("C", GOOD), (None, GOOD), ("D", b"[]"), ("E", GOOD)]
    base = spark.createDataFrame(rows, "csi_id string, json_content binary")
    df = base.coalesce(1).withColumns(
        {
            "index": F.monotonically_increasing_id(), "region": F.lit("EU"),
            "regulation": F.lit("R"), "json_config": F.lit("a.json"), "sql_file": F.lit("q.sql"),
            "template": F.lit(None).cast("string"), "sql_content": F.lit(b"S"),
            "tpl_content": F.lit(None).cast("binary"),
            "uploaded_at": F.lit("2024-01-01").cast("timestamp_ntz"),
        }
    )
    checked = validate(content_facts(df)).withColumns(
        {"seq": F.col("index"), "json_name": F.col("json_config"), "sql_name": F.col("sql_file"),
         "tpl_name": F.col("template")}
    )
    out = details(checked, route(checked.where("valid")))
    shown = [(r["index"], r.label, r.status) for r in out.orderBy("position").collect()]
    assert shown == [(1, "bundle-1", "failed"), (2, "D", "failed"), (0, "C", "created"),
                     (3, "E", "created")]
    assert tuple(summary(out).first()) == (2, 0, 0, 2, 4)
    lines = [r.message for r in errors(out).orderBy("index").collect()]
    assert lines[0].startswith("Bundle #1 'bundle-1': Bundle #1 (csi_id=?)")


@pytest.mark.parametrize(
    "code, plain",
    [("YWI=", b"ab"), ("YW*I=", b"ab"), ("YWI", None), ("YWI=YWI=", b"ab"), ("", b""), ("A", None)],
)
def test_base64(spark, code, plain):
    df = spark.createDataFrame([(code,)], "c string")
    got = df.select(text.decode_base64(F.col("c"))).first()[0]
    assert (None if got is None else bytes(got)) == plain


@pytest.mark.parametrize(
    "value, ok",
    [
        ("a1b2c3d4-e5f6-7890-abcd-ef1234567890", True),
        ("A1B2C3D4E5F67890ABCDEF1234567890", True),
        ("{a1b2c3d4-e5f6-7890-abcd-ef1234567890}", True),
        ("urn:uuid:a1b2c3d4-e5f6-7890-abcd-ef1234567890", True),
        ("a1b2c3d4", False),
        ("g1b2c3d4-e5f6-7890-abcd-ef1234567890", False),
    ],
)
def test_uuid(spark, value, ok):
    df = spark.createDataFrame([(value,)], "c string")
    assert df.select(text.is_uuid(F.col("c"))).first()[0] is ok


@pytest.mark.parametrize(
    "name, want", [("a.SQL", ".sql"), ("x/.sql", ""), ("a.tar.gz", ".gz"), ("a.", ""), ("a", "")]
)
def test_suffix(spark, name, want):
    df = spark.createDataFrame([(name,)], "c string")
    assert df.select(fp.suffix(F.col("c"))).first()[0] == want
