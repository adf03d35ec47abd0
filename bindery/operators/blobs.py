"""File contents, stored once per distinct content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import fingerprint as fp
from bindery.operators.skew import hashed_if_many, spread_join
from bindery.schemas import FILE_TYPES
from bindery.session import written

UPLOAD = ("seq", "file_type")
_SHORT = dict(zip(("json", "sql", "tpl"), FILE_TYPES))


def _file(short: str, *columns: str) -> Column:
    return F.struct(
        F.lit(_SHORT[short]).alias("file_type"),
        *[F.col(f"{short}_{c}").alias(c) for c in columns],
    )


def _uploads(rows: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    files = F.array(*[F.when(w, _file(s, "name", "sum", "size")) for s, w in wanted.items()])
    each = rows.select("seq", F.explode(files).alias("f")).where(F.col("f").isNotNull())
    return each.select(
        "seq",
        "f.file_type",
        F.col("f.name").alias("filename"),
        F.col("f.sum").alias("blob_id"),
        F.col("f.size").alias("length"),
    )


def uploads(routed: DataFrame) -> DataFrame:
    """One row per file that a routed bundle changes, without its content."""
    return _uploads(routed, {s: F.col(f"{s}_changed") for s in _SHORT})


def brought(patches: DataFrame) -> DataFrame:
    """One row per file that a patch brings: all of them are stored."""
    return _uploads(patches, {s: F.col(f"{s}_sum").isNotNull() for s in _SHORT})


def content_type(file_type: Column, filename: Column) -> Column:
    return F.when(file_type == FILE_TYPES[0], fp.CONFIG_CONTENT_TYPE).otherwise(
        fp.content_type(filename)
    )


def upload_plan(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The uploads to store: the first of each content that is not stored yet.

    Works on narrow rows. The aggregate is combined before the shuffle, so a
    content that a third of all bundles share costs one row per task.
    """
    first = F.struct("seq", "file_type", "filename", "length")
    plan = uploads.groupBy("blob_id").agg(F.min(first).alias("f"))
    if existing is not None:
        plan = plan.join(existing.select("blob_id"), "blob_id", "left_anti")
    return plan.select(
        "blob_id",
        "f.seq",
        "f.file_type",
        "f.filename",
        content_type(F.col("f.file_type"), F.col("f.filename")).alias("content_type"),
        "f.length",
    )


def contents(bundles: DataFrame) -> DataFrame:
    """Files of bundles with their contents, one row each."""
    files = F.array(*[_file(s, "content") for s in _SHORT])
    return bundles.select("seq", F.explode(files).alias("f")).select(
        "seq", "f.file_type", F.col("f.content").alias("content")
    )


def new_blobs(
    plan: DataFrame, contents: DataFrame, uploaded_at: Column, on: Sequence[str] = UPLOAD
) -> DataFrame:
    """Blob rows for a plan. Contents move once, and only in this last join,
    whose key is unique on both sides; they are not sorted for it."""
    return contents.join(hashed_if_many(written(plan, "upload-plan")), list(on)).select(
        "blob_id",
        "filename",
        "content_type",
        "length",
        uploaded_at.alias("upload_date"),
        F.col("blob_id").alias("checksum"),
        "content",
    )


def plan_by_path(plan: DataFrame, file_facts: DataFrame) -> DataFrame:
    """A plan for files on disk: one path per content to read it from."""
    paths = file_facts.groupBy(F.col("sum").alias("blob_id")).agg(F.min("path").alias("path"))
    return plan.join(paths, "blob_id")


def references(versions: DataFrame) -> DataFrame:
    """One row per file of each version: its blob, name and expected checksum."""
    files = F.array(
        *[
            F.struct(
                F.lit(f).alias("file_type"),
                F.col(f"file_contents.{f}_id").alias("blob_id"),
                F.col(f"original_files.{f}").alias("filename"),
                F.col(f"checksums.{f}").alias("expected"),
            )
            for f in FILE_TYPES
        ]
    )
    return versions.select("report_id", "version", F.inline(files)).where(
        F.col("blob_id").isNotNull()
    )


def orphans(blobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Blobs no version refers to, such as those of a batch that broke off."""
    used = references(versions).select("blob_id").distinct()
    return blobs.join(used, "blob_id", "left_anti")


def dangling(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """References to blobs that are not there."""
    return spread_join(
        references(versions),
        blobs.select("blob_id"),
        ("blob_id",),
        "left_anti",
        spread_by=("report_id", "version", "file_type"),
    )


def read_blobs(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content and metadata of requested blob ids; `found` is false for misses.

    The ids are the build side, so a few of them are sent to where the contents
    lie; misses come from a join on ids alone.
    """
    asked = wanted.select("blob_id").distinct()
    hits = blobs.join(asked, "blob_id", "left_semi").withColumn("found", F.lit(True))
    misses = asked.join(blobs.select("blob_id"), "blob_id", "left_anti")
    return hits.unionByName(misses.withColumn("found", F.lit(False)), allowMissingColumns=True)


def digests(blobs: DataFrame) -> DataFrame:
    """Checksum of what is really stored, per blob: the only step that reads
    contents for a verification."""
    return blobs.select("blob_id", fp.checksum(F.col("content")).alias("actual"))


def verify(blobs: DataFrame) -> DataFrame:
    """Compare stored contents with the recorded checksums."""
    actual = fp.checksum(F.col("content"))
    return blobs.select("blob_id", "checksum", (actual == F.col("checksum")).alias("verified"))
