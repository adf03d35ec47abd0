"""Bundles and patches that carry their files in base64, and the making of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from bindery.functions import text
from bindery.operators.patch import NO_FILE
from bindery.schemas import INLINE_BUNDLE, PATCH_REQUEST
from bindery.sources.manifests import numbered

CANNOT_DECODE = "Cannot decode "
_FILES = {"json": "json_config", "sql": "sql_file", "tpl": "template"}


def read_requests(spark, path: str, schema=INLINE_BUNDLE) -> DataFrame:
    """Request rows from JSON lines."""
    return spark.read.schema(schema).json(path)


def _body_type() -> T.StructType:
    fields = [f for f in INLINE_BUNDLE.fields if f.name not in ("seq", "submitted_at")]
    return T.StructType([T.StructField("bundles", T.ArrayType(T.StructType(fields)))])


def land_bodies(bodies: DataFrame, folder: str) -> None:
    """Write request bodies, `source` and `value`, as a table with many of them in a file.

    For bodies that come by the million: a file each would cost a task, a listing
    and a commit more than the bundles in it.
    """
    bodies.select("source", "value").write.mode("overwrite").parquet(folder)


def read_pushed(spark, path: str, landed: bool = False) -> DataFrame:
    """Request bodies of the form {"bundles": [...]}, one document per file, or with
    `landed` one per row of the table that `land_bodies` wrote.

    A bundle is known by its source and its place there. `seq` follows these; as it
    depends on the partitions, ids are made of the place and not of `seq`.
    """
    if landed:
        stored = spark.read.schema("source string, value string").parquet(path)
        docs = stored.select("source", F.from_json("value", _body_type()).alias("body"))
        rows = docs.select("source", F.posexplode("body.bundles"))
    else:
        docs = spark.read.schema(_body_type()).option("multiLine", True).json(path)
        rows = docs.select(F.input_file_name().alias("source"), F.posexplode("bundles"))
    rows = rows.select("source", F.col("pos").alias("index"), "col.*")
    return numbered(rows).withColumn("submitted_at", F.lit(None).cast("timestamp_ntz"))


def decode_bundles(requests: DataFrame) -> DataFrame:
    """Decode the contents. A template counts if it has both name and content.

    `undecodable` names the first file whose text is not base64.
    """
    has_tpl = F.coalesce(
        (F.col("template_filename") != "") & (F.col("template_content") != ""), F.lit(False)
    )
    asked = {"json": F.lit(True), "sql": F.lit(True), "tpl": has_tpl}
    out = requests
    bad = []
    for short, name in _FILES.items():
        decoded = F.when(asked[short], text.decode_base64(F.col(f"{name}_content")))
        out = out.withColumn(f"{short}_content", decoded)
        bad.append(F.when(asked[short] & F.col(f"{short}_content").isNull(), F.lit(name)))
    place = [c for c in ("source", "index") if c in requests.columns]
    return out.select(
        *place, "seq", "csi_id", "region", "regulation",
        F.coalesce("submitted_at", text.utc_now()).alias("uploaded_at"),
        F.col("json_config_filename").alias("json_name"),
        F.col("sql_file_filename").alias("sql_name"),
        F.when(has_tpl, F.col("template_filename")).alias("tpl_name"),
        "json_content", "sql_content", "tpl_content",
        F.coalesce(*bad).alias("undecodable"),
    )


def build_payload(bundles: DataFrame) -> DataFrame:
    """Request rows for bundles with contents; those without csi_id are left out."""
    named = bundles.where(F.col("csi_id") != "")
    has_tpl = F.col("tpl_content").isNotNull()
    return named.select(
        "seq", F.col("uploaded_at").alias("submitted_at"), "csi_id", "region", "regulation",
        F.col("json_name").alias("json_config_filename"),
        F.base64("json_content").alias("json_config_content"),
        F.col("sql_name").alias("sql_file_filename"),
        F.base64("sql_content").alias("sql_file_content"),
        F.when(has_tpl, F.col("tpl_name")).alias("template_filename"),
        F.when(has_tpl, F.base64("tpl_content")).alias("template_content"),
    )


def decode_patches(requests: DataFrame) -> DataFrame:
    """Check and decode patch requests; a content without a file name is ignored.

    One file that can't be decoded fails the patch as a whole. Patches count as
    uploaded now.
    """
    contents = [F.coalesce(F.col(f"{n}_content") != "", F.lit(False)) for n in _FILES.values()]
    usable = [
        c & F.coalesce(F.col(f"{n}_filename") != "", F.lit(False))
        for c, n in zip(contents, _FILES.values())
    ]
    out = requests.withColumn(
        "error",
        F.when(
            ~F.coalesce(text.is_uuid(F.col("report_id")), F.lit(False)),
            F.concat(
                F.lit("Invalid report_id format: '"),
                F.coalesce("report_id", F.lit("None")),
                F.lit("' must be a UUID"),
            ),
        )
        .when(~(contents[0] | contents[1] | contents[2]), "At least one file must be provided.")
        .when(~(usable[0] | usable[1] | usable[2]), NO_FILE),
    )
    for (short, name), use in zip(_FILES.items(), usable):
        out = out.withColumns(
            {
                f"{short}_name": F.when(use, F.col(f"{name}_filename")),
                f"{short}_content": F.when(use, text.decode_base64(F.col(f"{name}_content"))),
            }
        )
    broken = [
        F.when(use & F.col(f"{short}_content").isNull(), f"{CANNOT_DECODE}{name}")
        for (short, name), use in zip(_FILES.items(), usable)
    ]
    return out.withColumn("error", F.coalesce("error", *broken)).select(
        "seq", "report_id", "error", text.utc_now().alias("uploaded_at"),
        *[f"{s}_{c}" for s in _FILES for c in ("name", "content")],
    )


def read_patches(spark, path: str) -> DataFrame:
    return read_requests(spark, path, PATCH_REQUEST)

