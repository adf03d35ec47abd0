"""Version chains: which version is active, what happened to it, its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import text
from bindery.operators.skew import spread_join
from bindery.schemas import KEY3

# Audit actions and texts.
ACTION_CREATED, ACTION_MODIFIED, ACTION_DEACTIVATED = "CREATED", "MODIFIED", "DEACTIVATED"
SUPERSEDED_TEXT = "Superseded by version "


# A report never changes its KEY3. Having it in the join key as well lets the
# optimizer carry a filter on one of its columns over to both sides.
_STEP = ("report_id", "version", *KEY3)


def _successors(versions: DataFrame) -> DataFrame:
    return versions.select(
        "report_id",
        (F.col("version") - 1).alias("version"),
        *KEY3,
        F.col("uploaded_at").alias("superseded_at"),
    )


def with_successor(versions: DataFrame) -> DataFrame:
    """Add `active` and `superseded_at`, the time of the next version.

    Active is the highest version of a report, wherever a purge has left gaps.
    Both joins are on (report_id, version), which is unique, so the rows of a
    report with a very long chain spread over all tasks; the highest version is
    an aggregate that is combined before its shuffle.
    """
    newest = _newest(versions).withColumn("active", F.lit(True))
    return (
        versions.join(_successors(versions), list(_STEP), "left")
        .join(newest, list(_STEP), "left")
        .withColumn("active", F.coalesce("active", F.lit(False)))
    )


def _newest(versions: DataFrame) -> DataFrame:
    highest = versions.groupBy("report_id", *KEY3).agg(F.max("version").alias("version"))
    return highest.select(*_STEP)


def active_versions(versions: DataFrame) -> DataFrame:
    """The highest version of each report."""
    return versions.join(_newest(versions), list(_STEP), "left_semi")


def unreplaced_versions(versions: DataFrame) -> DataFrame:
    """Versions without a next one: more than one in a report tells of a gap or a repeat."""
    nxt = _successors(versions).drop("superseded_at")
    return versions.join(nxt, list(_STEP), "left_anti")


def _own_entry() -> Column:
    return F.struct(
        F.when(F.col("version") == 1, ACTION_CREATED).otherwise(ACTION_MODIFIED).alias("action"),
        F.col("uploaded_at").alias("timestamp"),
        F.col("change").alias("details"),
    )


def _end_entry(version: Column, at: Column) -> Column:
    return F.struct(
        F.lit(ACTION_DEACTIVATED).alias("action"),
        at.alias("timestamp"),
        F.concat(F.lit(SUPERSEDED_TEXT), version.cast("string")).alias("details"),
    )


def audit_feed(versions: DataFrame) -> DataFrame:
    """Flat audit log. A version also tells of the end of the one before it, so
    each row yields its entries alone: no shuffle, and it works on a stream."""
    own = F.struct(F.col("version"), *[_own_entry()[f].alias(f) for f in _ENTRY])
    end = _end_entry(F.col("version"), F.col("uploaded_at"))
    before = F.struct((F.col("version") - 1).alias("version"), *[end[f].alias(f) for f in _ENTRY])
    entries = F.when(F.col("version") > 1, F.array(own, before)).otherwise(F.array(own))
    return versions.select("report_id", F.inline(entries))


_ENTRY = ("action", "timestamp", "details")


def with_audit_log(versions: DataFrame) -> DataFrame:
    """Add `active` and the nested `audit_log` to whole version rows."""
    end = _end_entry(F.col("version") + 1, F.col("superseded_at"))
    log = F.when(F.col("active"), F.array(_own_entry())).otherwise(F.array(_own_entry(), end))
    return with_successor(versions).withColumn("audit_log", log).drop("superseded_at")


def history(versions: DataFrame, report_ids: DataFrame) -> DataFrame:
    """All versions in the KEY3 groups of the given reports, each one once, with
    the number of versions in its group. Sort by `HISTORY_ORDER` to display."""
    groups = (
        versions.join(report_ids.select("report_id").distinct(), "report_id", "left_semi")
        .select(*KEY3)
        .distinct()
    )
    totals = versions.groupBy(*KEY3).agg(F.count("*").alias("total_versions"))
    # The groups are distinct, so the join to the versions cannot multiply rows.
    wanted = totals.join(groups, list(KEY3), "left_semi")
    return spread_join(versions, wanted, KEY3, "inner", spread_by=("report_id", "version"))


# Fixed value: error of a report that nobody knows.
NO_REPORT_ID = "No records found with report_id '"


def anchored(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """Each report id asked for, once, with `found`, its KEY3 group and, for those
    that no version has, an `error`."""
    homes = versions.groupBy("report_id").agg(*[F.first(k).alias(k) for k in KEY3])
    homes = homes.withColumn("found", F.lit(True))
    rows = asked.select("report_id").distinct().join(homes, "report_id", "left")
    missing = F.concat(F.lit(NO_REPORT_ID), F.coalesce("report_id", F.lit("")), F.lit("'"))
    found = F.coalesce("found", F.lit(False))
    return rows.withColumns({"found": found, "error": F.when(~found, missing)})


def history_requests(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """What a history request finds: `total_versions` of the group of each report
    asked for, or the `error` that there is none. `history` has the versions."""
    totals = versions.groupBy(*KEY3).agg(F.count("*").alias("total_versions"))
    return anchored(versions, asked).join(totals, list(KEY3), "left")


HISTORY_ORDER = ("version", "uploaded_at", "report_id")


def history_view(versions: DataFrame) -> DataFrame:
    """Display form of a history: dates, files and audit entries as text."""
    files = F.concat(
        F.lit("config: "),
        F.col("original_files.json_config"),
        F.coalesce(F.concat(F.lit("\ntemplate: "), F.col("original_files.template")), F.lit("")),
        F.lit("\nsql: "),
        F.col("original_files.sql_file"),
    )
    audit = F.array_join(
        F.transform(
            "audit_log", lambda e: F.concat(F.lit("["), e["action"], F.lit("] "), e["details"])
        ),
        "\n",
    )
    return with_audit_log(versions).select(
        *KEY3,
        "report_id",
        "version",
        "active",
        F.date_format("uploaded_at", text.SECOND_FORMAT).alias("uploaded"),
        files.alias("files"),
        audit.alias("audit"),
    )
