"""Import of stored documents, as a document store dumps them: one JSON text each.

Dumps use extended JSON: ids as `{"$oid": …}`, times as `{"$date": …}` (an ISO
text, or milliseconds in `{"$numberLong": …}`) and numbers as `{"$numberInt": …}`
or `{"$numberLong": …}`. Plain values are taken as well. Everything is read from
one parsed variant inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.schemas import FILE_TYPES, VERSIONS

# Fixed value: what is wrong with a text that is no JSON document.
NOT_JSON = "not a JSON document"

_DOC = "_doc"


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(_DOC), path, kind)


def _text(path: str) -> Column:
    """A JSON string; numbers and the like are not taken for one."""
    shape = F.schema_of_variant(F.try_variant_get(F.col(_DOC), path, "variant"))
    return F.when(shape == "STRING", _get(path))


def _number(path: str) -> Column:
    return F.coalesce(
        _get(path, "long"), _get(f"{path}['$numberInt']", "long"), _get(f"{path}['$numberLong']", "long")
    )


def _time(path: str) -> Column:
    """UTC wall clock, whatever the session's time zone."""
    iso = F.coalesce(_get(f"{path}['$date']"), _get(path))
    millis = _get(f"{path}['$date']['$numberLong']", "long")
    at = F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp(iso))
    return F.to_timestamp_ntz(F.to_utc_timestamp(at, F.current_timezone()))


def read_documents(texts: DataFrame, column: str = "record") -> DataFrame:
    """Version rows out of documents, with an `error` where one can't be taken.

    A document whose `_id` is no object id is no record but a counter kept among
    them, and is left out. A text that is no JSON, or lacks what a version needs,
    comes back with `error` set and null fields; nothing else is dropped, and
    other columns of `texts` go along.
    """
    # names of the result replace columns of the same name
    added = [*VERSIONS.fieldNames(), "active", "error"]
    rest = [F.col(f"`{c}`") for c in texts.columns if c not in added]
    rows = texts.select(*rest, F.try_parse_json(F.col(column)).alias(_DOC))
    is_object = F.schema_of_variant(_DOC).startswith("OBJECT")
    rows = rows.where(~F.coalesce(is_object, F.lit(False)) | _get("$._id['$oid']").isNotNull())

    def per_file(name: str, read, suffix: str = "") -> Column:
        return F.struct(*[read(f"$.{name}.{f}{suffix}").alias(f"{f}{suffix}") for f in FILE_TYPES])

    fields = {k: _text(f"$.{k}") for k in ("report_id", "csi_id", "region", "regulation", "name")}
    fields |= {
        "original_files": per_file("original_files", _text),
        "file_contents": per_file("file_contents", _text, "_id"),
        "checksums": per_file("checksums", _text),
        "file_sizes": per_file("file_sizes", _number),
        "uploaded_at": _time("$.uploaded_at"),
        "version": _number("$.version").cast("int"),
        "change": F.coalesce(_text("$.audit_log[0].details"), F.lit("")),
        "active": F.coalesce(_get("$.active", "boolean"), F.lit(True)),
    }
    rows = rows.withColumns(fields)
    needed = {k: F.col(k).isNotNull() for k in ("report_id", "csi_id", "region", "regulation", "name")}
    for part in ("original_files", "checksums", "file_sizes"):
        for f in FILE_TYPES[:2]:
            needed[f"{part}.{f}"] = F.col(f"{part}.{f}").isNotNull()
    needed["uploaded_at"] = F.col("uploaded_at").isNotNull()
    needed["version"] = F.coalesce(F.col("version") >= 1, F.lit(False))
    lacking = F.concat_ws(", ", *[F.when(~ok, F.lit(k)) for k, ok in needed.items()])
    parsed = F.coalesce(F.schema_of_variant(_DOC).startswith("OBJECT"), F.lit(False))
    error = F.when(~parsed, NOT_JSON).when(
        lacking != "", F.concat(F.lit("missing or of another type: "), lacking)
    )
    rows = rows.withColumn("error", error)
    good = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in added[:-1]]
    return rows.select(*rest, *good, "error")
