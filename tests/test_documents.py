"""Import of stored documents: ways to write values, and what is refused."""

import datetime as dt
import json

from bindery.sources.documents import NOT_JSON, read_documents

GOOD = {
    "_id": {"$oid": "65a000000000000000000001"}, "report_id": "r", "csi_id": "C", "region": "EU",
    "regulation": "X", "name": "n", "original_files": {"json_config": "a.json", "sql_file": "a.sql"},
    "file_contents": {"json_config_id": "j", "sql_file_id": "s", "template_id": None},
    "checksums": {"json_config": "j", "sql_file": "s", "template": None},
    "file_sizes": {"json_config": {"$numberLong": "5"}, "sql_file": 7},
    "uploaded_at": {"$date": "2024-02-03T04:05:06.007Z"}, "active": False, "version": {"$numberInt": "2"},
    "audit_log": [{"action": "MODIFIED", "details": "d"}],
}


def test_values_and_refusals(spark):
    texts = [
        json.dumps(GOOD),
        json.dumps(GOOD | {"uploaded_at": {"$date": {"$numberLong": "1706933106007"}}, "version": 2}),
        json.dumps(GOOD | {"uploaded_at": "2024-02-03T05:05:06.007+01:00"}),
        json.dumps({"_id": "report_id_seq", "seq": 9}),
        json.dumps(GOOD | {"version": 0, "csi_id": 7}),
        json.dumps(GOOD | {"uploaded_at": "soon", "checksums": {}}),
        '{"_id":', "", "[1]", None,
    ]
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "i int, record string, name string")
    got = {r.i: r for r in read_documents(docs).collect()}
    assert set(got) == set(range(len(texts))) - {3}
    for i in range(3):
        r = got[i]
        assert (r.error, r.version, r.active, r.change, r.name) == (None, 2, False, "d", "n")
        assert r.uploaded_at == dt.datetime(2024, 2, 3, 4, 5, 6, 7000)
        assert tuple(r.file_sizes) == (5, 7, None) and r.original_files.template is None
    assert got[4].error == "missing or of another type: csi_id, version"
    assert "checksums.sql_file" in got[5].error and "uploaded_at" in got[5].error
    assert got[5].report_id is None
    assert [got[i].error for i in (6, 7, 8, 9)] == [NOT_JSON] * 4
