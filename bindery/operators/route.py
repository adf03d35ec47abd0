"""Decide for every submitted bundle whether it creates, updates or is skipped.

Bundles of one key are taken in order and each is compared with what the one
before it left behind. That state is always visible in the earlier rows of the
batch or in the active version the batch started from, so the whole batch is a
windowed scan and not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bindery.functions import fingerprint as fp
from bindery.operators.ordered import SEGMENT, SEGMENT_ROWS, Order, running, segmented
from bindery.operators.skew import spread_join
from bindery.schemas import CREATED, FILE_TYPES, KEY4, SKIPPED, UPDATED

ORDER = Order(KEY4, "seq")

# Reasons and audit texts.
REASON_NEW = "new record"
REASON_SAME = "checksums unchanged"
REASON_CHANGED = "changed: "
CREATED_TEXT = "Initial seed from manifest"
CHANGED_TEXT = "Changed: "
PATCHED_TEXT = "Updated "
ARROW = " → "


def base_rows(active: DataFrame) -> DataFrame:
    """Active versions as the rows that precede a batch."""
    return active.select(
        F.lit(-1).cast("long").alias("seq"),
        *KEY4[:3],
        F.col("original_files.json_config").alias("json_name"),
        F.col("original_files.sql_file").alias("sql_name"),
        F.col("original_files.template").alias("tpl_name"),
        F.col("checksums.json_config").alias("json_sum"),
        F.col("checksums.sql_file").alias("sql_sum"),
        F.col("checksums.template").alias("tpl_sum"),
        F.col("file_sizes.json_config").alias("json_size"),
        F.col("file_sizes.sql_file").alias("sql_size"),
        F.col("file_sizes.template").alias("tpl_size"),
        "name",
        "uploaded_at",
        F.col("report_id").alias("_base_report"),
        F.col("version").alias("_base_version"),
    )


def _listed(*flags: str) -> F.Column:
    named = [F.when(F.col(f), t) for f, t in zip(flags, FILE_TYPES)]
    return F.concat_ws(", ", *named)


def route(
    bundles: DataFrame,
    active: DataFrame | None = None,
    batch_id: str = "0",
    segment_rows: int = SEGMENT_ROWS,
    carry: Sequence[str] = (),
    identity: str | F.Column = "seq",
) -> DataFrame:
    """Route bundles, known by their facts, against the active versions.

    `seq` is unique, not negative, and gives the processing order. Each row
    comes back with `status`, `reason`, `report_id`, `version`, `is_new_version`
    and the effective files of the record after it; columns named in `carry`
    come along. New report ids are made of the key, the batch and `identity`,
    an expression that is unique within the batch and the same when it runs again.
    """
    rows = bundles.select(
        "seq", *KEY4, "sql_name", "tpl_name", "json_sum", "sql_sum", "tpl_sum",
        "json_size", "sql_size", "tpl_size", "name", "uploaded_at",
        F.lit(None).cast("string").alias("_base_report"),
        F.lit(None).cast("int").alias("_base_version"), *carry,
    )
    if active is not None:
        # Only keys that the batch touches take part in the scan.
        keys = bundles.select(*KEY4).distinct()
        touched = base_rows(active).join(keys, list(KEY4), "left_semi")
        rows = rows.unionByName(touched, allowMissingColumns=True)

    rows, order = segmented(rows, ORDER, segment_rows, counted=bundles)
    rows = running(
        rows,
        order,
        last={c: F.col(c[5:]) for c in ("prev_json_sum", "prev_sql_sum", "prev_tpl_sum")},
        before_only=True,
    )
    is_base = F.col("_base_version").isNotNull()
    rows = (
        rows.withColumn("is_first", F.col("prev_json_sum").isNull())
        .withColumn("json_changed", ~F.col("json_sum").eqNullSafe(F.col("prev_json_sum")))
        .withColumn("sql_changed", ~F.col("sql_sum").eqNullSafe(F.col("prev_sql_sum")))
        # A bundle without a template keeps the stored one, yet it differs from it.
        .withColumn("tpl_differs", ~F.col("tpl_sum").eqNullSafe(F.col("prev_tpl_sum")))
        .withColumn("tpl_changed", F.col("tpl_sum").isNotNull() & F.col("tpl_differs"))
        .withColumn(
            "is_new_version",
            F.col("is_first") | F.col("json_changed") | F.col("sql_changed") | F.col("tpl_changed"),
        )
    )
    own_id = fp.report_id(KEY4, batch_id, identity)
    tpl = F.struct("tpl_name", "tpl_sum", "tpl_size")
    rows = running(
        rows,
        order,
        total={"_version": F.coalesce("_base_version", F.col("is_new_version").cast("int"))},
        last={
            "report_id": F.coalesce("_base_report", F.when(F.col("is_first"), own_id)),
            # Identical bytes under a new name keep the stored name.
            "stored_sql_name": F.when(F.col("sql_changed"), F.col("sql_name")),
            "stored_tpl": F.when(F.col("tpl_changed"), tpl),
        },
    )
    status = (
        F.when(F.col("is_first"), CREATED)
        .when(F.col("json_changed") | F.col("sql_changed") | F.col("tpl_differs"), UPDATED)
        .otherwise(SKIPPED)
    )
    return (
        rows.where(~is_base)
        .withColumn("version", F.col("_version").cast("int"))
        .withColumn("status", status)
        .withColumn(
            "reason",
            F.when(F.col("status") == CREATED, REASON_NEW)
            .when(F.col("status") == SKIPPED, REASON_SAME)
            .otherwise(
                F.concat(
                    F.lit(REASON_CHANGED), _listed("json_changed", "sql_changed", "tpl_differs")
                )
            ),
        )
        .withColumn("changed", _listed("json_changed", "sql_changed", "tpl_changed"))
        .drop("_base_report", "_base_version", "_version", SEGMENT)
    )


# Parts of the error of a stored version without one of its files.
MODIFY_FAILED, CORRUPT = "Modify failed for report_id='", "': Corrupt record report_id='"
CORRUPT_FILE, CORRUPT_END = "': missing ", "_id in file_contents"


def _lacks(file_type: str) -> F.Column:
    return F.col(f"file_contents.{file_type}_id").isNull()


def lacking() -> F.Column:
    """Whether a stored version has no config or no SQL."""
    return _lacks(FILE_TYPES[0]) | _lacks(FILE_TYPES[1])


def corrupt(bundles: DataFrame, active: DataFrame) -> DataFrame:
    """seq, report_id, error of bundles that would carry over a file that the stored
    version doesn't have.

    A bundle that changes something, but not a part whose file id is missing, fails
    and leaves the record as it is. The first that brings all missing parts anew
    mends it, and bundles behind that one have nothing to fail by. An unchanged
    bundle is skipped before its files are looked at.
    """
    parts = dict(zip(("json", "sql", "tpl"), FILE_TYPES))
    lacks = {s: _lacks(parts[s]) for s in ("json", "sql")}
    bad = active.where(lacking()).select(
        *KEY4[:3], F.col("original_files.json_config").alias("json_name"),
        F.col("report_id").alias("_report"),
        *[lacks[s].alias(f"_no_{s}") for s in lacks],
        *[F.col(f"checksums.{f}").alias(f"_{s}") for s, f in parts.items()],
    )
    rows = bundles.select("seq", *KEY4, "json_sum", "sql_sum", "tpl_sum")
    rows = spread_join(rows, bad, KEY4, "inner", spread_by=("seq",))
    new = {s: ~F.col(f"{s}_sum").eqNullSafe(F.col(f"_{s}")) for s in parts}
    part = F.when(~new["json"] & F.col("_no_json"), FILE_TYPES[0]).when(
        ~new["sql"] & F.col("_no_sql"), FILE_TYPES[1]
    )
    rows = rows.where(new["json"] | new["sql"] | new["tpl"]).withColumn("_part", part)
    mended = rows.where("_part IS NULL").groupBy("_report").agg(F.min("seq").alias("_mended"))
    rows = rows.where("_part IS NOT NULL").join(mended, "_report", "left")
    said = F.concat(
        F.lit(MODIFY_FAILED), "_report", F.lit(CORRUPT), "_report", F.lit(CORRUPT_FILE), "_part",
        F.lit(CORRUPT_END),
    )
    return rows.where("_mended IS NULL OR seq < _mended").select(
        "seq", F.col("_report").alias("report_id"), said.alias("error")
    )


def step_text(prefix: str, changed: F.Column, version: F.Column) -> F.Column:
    """Audit text of a change, such as `Changed: sql_file (v1 → v2)`."""
    before, after = (version - 1).cast("string"), version.cast("string")
    return F.concat(
        F.lit(prefix), changed, F.lit(" (v"), before, F.lit(f"{ARROW}v"), after, F.lit(")")
    )


def as_versions(rows: DataFrame, change: F.Column) -> DataFrame:
    """Version rows from flat ones with the effective files of the record."""

    def per_file(column: str, suffix: str = "") -> F.Column:
        pairs = zip(("json", "sql", "tpl"), FILE_TYPES)
        return F.struct(*[F.col(f"{s}_{column}").alias(f"{f}{suffix}") for s, f in pairs])

    return rows.select(
        "report_id",
        *KEY4[:3],
        "name",
        per_file("name").alias("original_files"),
        # Blobs are addressed by content, so the checksum is the blob id.
        per_file("sum", "_id").alias("file_contents"),
        per_file("sum").alias("checksums"),
        per_file("size").alias("file_sizes"),
        "uploaded_at",
        "version",
        change.alias("change"),
    )


def version_rows(routed: DataFrame) -> DataFrame:
    """The rows a routed batch appends to the version table."""
    effective = routed.where("is_new_version").withColumns(
        {
            "sql_name": F.col("stored_sql_name"),
            "tpl_name": F.col("stored_tpl.tpl_name"),
            "tpl_sum": F.col("stored_tpl.tpl_sum"),
            "tpl_size": F.col("stored_tpl.tpl_size"),
        }
    )
    change = F.when(F.col("version") == 1, CREATED_TEXT).otherwise(
        step_text(CHANGED_TEXT, F.col("changed"), F.col("version"))
    )
    return as_versions(effective, change)


def create_only(
    bundles: DataFrame,
    active: DataFrame | None = None,
    batch_id: str = "0",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Accept the first bundle of each free key, reject the rest as duplicates."""
    rows = bundles.select(
        "seq", *KEY4, F.lit(None).cast("string").alias("_holder")
    )
    if active is not None:
        keys = bundles.select(*KEY4).distinct()
        held = base_rows(active).select("seq", *KEY4, F.col("_base_report").alias("_holder"))
        rows = rows.unionByName(held.join(keys, list(KEY4), "left_semi"))
    rows, order = segmented(rows, ORDER, segment_rows, counted=bundles)
    rows = running(rows, order, last={"_prior": F.col("seq")}, before_only=True)
    is_first = F.col("_prior").isNull()
    own_id = F.when(is_first, fp.report_id(KEY4, batch_id, "seq"))
    rows = running(rows, order, last={"report_id": F.coalesce("_holder", own_id)})
    csi_id, region, regulation, config = (F.coalesce(k, F.lit("")) for k in KEY4)
    duplicate = F.concat(
        F.lit("An active record already exists for csi_id='"), csi_id,
        F.lit("' regulation='"), regulation,
        F.lit("' region='"), region,
        F.lit("' json_config='"), config,
        F.lit("' (internal report_id="), F.col("report_id"),
        F.lit("). Use 'modify' to update it."),
    )
    return rows.where("seq >= 0").select(
        "seq",
        *KEY4,
        "report_id",
        F.when(is_first, CREATED).otherwise("failed").alias("status"),
        F.when(~is_first, duplicate).alias("error"),
    )
