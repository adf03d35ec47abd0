"""Which old versions may go, and which blobs nobody needs after that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindery.operators.chain import anchored
from bindery.operators.skew import spread_join
from bindery.schemas import KEY3

# Parts that a large group is thinned in before it is ranked as a whole.
SALTS = 4096

# Default retention.
KEEP_VERSIONS = 3
MAX_AGE_DAYS = 90

ROW_ID = ("report_id", "version")


def _scope(scope: str) -> tuple[str, ...]:
    return {"triple": KEY3, "record": ("report_id",)}[scope]


def _newest_inactive(inactive: DataFrame, group: tuple[str, ...], keep: int) -> DataFrame:
    """Rank the newest `keep` inactive versions of each group.

    Spark limits each group to `keep` rows within every task before the
    shuffle, so a hot group arrives small. It does so up to a threshold; for a
    larger `keep` the groups are first thinned out in salted parts.
    """
    newest = [F.desc("version"), F.desc("uploaded_at"), F.col("report_id")]
    slim = inactive.select(*dict.fromkeys((*group, *ROW_ID, "uploaded_at")))
    spark = inactive.sparkSession
    if keep > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        slim = slim.withColumn("_salt", F.pmod(F.xxhash64(*ROW_ID), F.lit(SALTS)))
        part = Window.partitionBy(*group, "_salt").orderBy(*newest)
        slim = slim.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= keep)
    whole = Window.partitionBy(*group).orderBy(*newest)
    return slim.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= keep)


def purge_plan(
    versions: DataFrame,
    keep: int = KEEP_VERSIONS,
    scope: str = "triple",
    report_ids: DataFrame | None = None,
) -> DataFrame:
    """Versions to purge so that each group holds `keep`, active ones included.

    Active versions stay and use up slots; the newest inactive ones fill the
    rest. By default a group is all of a KEY3, so several records may share it;
    `scope="record"` keeps records apart. `report_ids` limits the plan to the
    groups of these reports.
    """
    group = _scope(scope)
    if report_ids is not None:
        anchors = report_ids.select("report_id").distinct()
        groups = versions.join(anchors, "report_id", "left_semi").select(*group).distinct()
        versions = spread_join(versions, groups, group, "left_semi", spread_by=ROW_ID)
    inactive = versions.where(~F.col("active"))
    held = versions.groupBy(*group).agg(F.count_if("active").alias("n_active"))
    kept = (
        _newest_inactive(inactive, group, keep)
        .join(held, list(group))
        .where(F.col("rank") <= F.lit(keep) - F.col("n_active"))
    )
    return inactive.join(kept.select(*ROW_ID), list(ROW_ID), "left_anti")


def purge_by_age(
    versions: DataFrame, as_of: Column, max_age_days: int = MAX_AGE_DAYS
) -> DataFrame:
    """Inactive versions uploaded more than `max_age_days` before `as_of`."""
    cutoff = as_of - F.make_dt_interval(F.lit(max_age_days))
    return versions.where(~F.col("active") & (F.col("uploaded_at") < cutoff))


def purge_counts(versions: DataFrame, plan: DataFrame, scope: str = "triple") -> DataFrame:
    """Per group: versions purged and kept."""
    group = _scope(scope)
    purged = plan.groupBy(*group).agg(F.count("*").alias("purged"))
    return (
        versions.groupBy(*group)
        .agg(F.count("*").alias("n"))
        .join(purged, list(group), "left")
        .withColumn("purged", F.coalesce("purged", F.lit(0).cast("long")))
        .select(*group, "purged", (F.col("n") - F.col("purged")).alias("kept"))
    )


def counts_between(before: DataFrame, after: DataFrame, scope: str = "triple") -> DataFrame:
    """Per group, versions purged and kept, where `after` is what a purge left of `before`.

    Counts alone, combined before the shuffle.
    """
    group = _scope(scope)
    both = before.select(*group, F.lit(0).cast("long").alias("stayed")).union(
        after.select(*group, F.lit(1).cast("long"))
    )
    counts = both.groupBy(*group).agg(
        F.count_if(F.col("stayed") == 0).alias("n"), F.sum("stayed").alias("kept")
    )
    return counts.select(*group, (F.col("n") - F.col("kept")).alias("purged"), "kept")


def purge_requests(versions: DataFrame, asked: DataFrame, keep: int = KEEP_VERSIONS) -> DataFrame:
    """What a purge of each report asked for does: `purged` and `kept` of its group, or
    the `error` that there is no such report."""
    plan = purge_plan(versions, keep, report_ids=asked)
    counts = purge_counts(versions, plan)
    return anchored(versions, asked).join(counts, list(KEY3), "left")


def purge_totals(counts: DataFrame) -> DataFrame:
    """Over all groups: versions purged and groups looked at."""
    return counts.agg(
        F.coalesce(F.sum("purged"), F.lit(0)).alias("total_purged"),
        F.count("*").alias("records_processed"),
    )


def logical_records(versions: DataFrame) -> DataFrame:
    """The KEY3 groups there are, with their sizes."""
    return versions.groupBy(*KEY3).agg(F.count("*").alias("n_versions"))


def survivors(versions: DataFrame, plan: DataFrame) -> DataFrame:
    return versions.join(plan.select(*ROW_ID), list(ROW_ID), "left_anti")


def blob_fates(versions: DataFrame, plan: DataFrame) -> DataFrame:
    """For each blob that a purged version refers to: may it be deleted?

    Versions share unchanged files, so a blob goes only if no version that
    stays refers to it. Counting both kinds of references in one aggregate
    combines them before the shuffle, however often a blob is shared.
    """
    marked = versions.join(
        plan.select(*ROW_ID, F.lit(True).alias("_purged")), list(ROW_ID), "left"
    )
    refs = marked.select(
        F.explode(
            F.array(
                "file_contents.json_config_id",
                "file_contents.sql_file_id",
                "file_contents.template_id",
            )
        ).alias("blob_id"),
        F.coalesce("_purged", F.lit(False)).alias("purged"),
    ).where(F.col("blob_id").isNotNull())
    return (
        refs.groupBy("blob_id")
        .agg(
            F.count_if("purged").alias("purged_refs"), F.count_if(~F.col("purged")).alias("kept_refs")
        )
        .where("purged_refs > 0")
    )


def blob_gc(versions: DataFrame, plan: DataFrame) -> DataFrame:
    """Blobs to delete along with a purge."""
    return blob_fates(versions, plan).where("kept_refs = 0").select("blob_id", "purged_refs")


def blob_gc_unsafe(versions: DataFrame, plan: DataFrame) -> DataFrame:
    """Blobs that a purge without reference check would wrongly delete."""
    return blob_fates(versions, plan).where("kept_refs > 0")
