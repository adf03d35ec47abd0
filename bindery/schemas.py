"""Table layouts and the two key scopes of the registry."""

from __future__ import annotations

from pyspark.sql import types as T

# A record is identified by KEY4; history and retention look at the wider KEY3
# group, which may hold several records with different config files.
KEY3 = ("csi_id", "region", "regulation")
KEY4 = (*KEY3, "json_name")

# The three parts of a bundle, in reporting order.
FILE_TYPES = ("json_config", "sql_file", "template")

# Statuses a bundle or patch can end in.
CREATED, UPDATED, SKIPPED, FAILED = "created", "updated", "skipped", "failed"


def _per_file(dtype: T.DataType, suffix: str = "") -> T.StructType:
    return T.StructType(
        [T.StructField(f"{f}{suffix}", dtype, f == "template") for f in FILE_TYPES]
    )


# One row per version. There is no `active` column on disk: a version is active
# while no later version of its report exists, which readers derive.
VERSIONS = T.StructType(
    [
        T.StructField("report_id", T.StringType(), False),
        T.StructField("csi_id", T.StringType(), False),
        T.StructField("region", T.StringType(), False),
        T.StructField("regulation", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("original_files", _per_file(T.StringType()), False),
        T.StructField("file_contents", _per_file(T.StringType(), "_id"), False),
        T.StructField("checksums", _per_file(T.StringType()), False),
        T.StructField("file_sizes", _per_file(T.LongType()), False),
        T.StructField("uploaded_at", T.TimestampNTZType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("change", T.StringType(), False),
    ]
)

BLOBS = T.StructType(
    [
        T.StructField("blob_id", T.StringType(), False),
        T.StructField("filename", T.StringType(), True),
        T.StructField("content_type", T.StringType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("upload_date", T.TimestampNTZType(), True),
        T.StructField("checksum", T.StringType(), False),
        T.StructField("content", T.BinaryType(), False),
    ]
)

# What became of each row of a batch, of whatever kind. `position` sorts as reported.
OUTCOMES = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("source", T.StringType(), True),
        T.StructField("index", T.LongType(), True),
        T.StructField("label", T.StringType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("report_id", T.StringType(), True),
        T.StructField("version", T.IntegerType(), True),
        T.StructField("reason", T.StringType(), True),
        T.StructField("changed", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
        T.StructField(
            "position",
            T.StructType(
                [T.StructField("group", T.IntegerType()), T.StructField("index", T.LongType())]
            ),
            True,
        ),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("report_id", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), True),
        T.StructField("details", T.StringType(), True),
    ]
)

# One entry of a manifest; paths are relative to the manifest's folder.
MANIFEST_ENTRY = T.StructType(
    [
        T.StructField("csi_id", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("regulation", T.StringType(), True),
        T.StructField("json_config", T.StringType(), True),
        T.StructField("sql_file", T.StringType(), True),
        T.StructField("template", T.StringType(), True),
    ]
)

# A bundle pushed with its contents in base64.
INLINE_BUNDLE = T.StructType(
    [
        T.StructField("seq", T.LongType(), True),
        T.StructField("submitted_at", T.TimestampNTZType(), True),
        T.StructField("csi_id", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("regulation", T.StringType(), True),
        T.StructField("json_config_filename", T.StringType(), True),
        T.StructField("json_config_content", T.StringType(), True),
        T.StructField("sql_file_filename", T.StringType(), True),
        T.StructField("sql_file_content", T.StringType(), True),
        T.StructField("template_filename", T.StringType(), True),
        T.StructField("template_content", T.StringType(), True),
    ]
)

# A partial change of one record.
PATCH_REQUEST = T.StructType(
    [T.StructField("seq", T.LongType(), True), T.StructField("report_id", T.StringType(), True)]
    + [f for f in INLINE_BUNDLE.fields if f.name.endswith(("_filename", "_content"))]
)
