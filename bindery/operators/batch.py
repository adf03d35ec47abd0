"""What a batch reports: one row per bundle, and counters over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindery.schemas import CREATED, FAILED, SKIPPED, UPDATED

# Reasons for failures.
PRE_FAILED = "Pre-validation failed"
IN_PROCESS = "Processing error"


def label(empty_is_missing: bool = False) -> F.Column:
    """The csi_id, or `bundle-i` where there is none."""
    csi = F.when(F.col("csi_id") != "", F.col("csi_id")) if empty_is_missing else F.col("csi_id")
    return F.coalesce(csi, F.concat(F.lit("bundle-"), F.col("index").cast("string")))


def details(checked: DataFrame, routed: DataFrame, inline: bool = False) -> DataFrame:
    """One row per bundle of the batch, failed or routed.

    `checked` holds `index`, `csi_id`, `valid` and `error`; `routed` what the
    router made of the valid ones, with `index` carried along or else equal to
    `seq`. A `source` in both is kept. `position` sorts as reported: failures of
    a manifest come first, those of pushed bundles stay in place.
    """
    if "index" not in routed.columns:
        routed = routed.withColumn("index", F.col("seq"))
    source = ["source"] if "source" in checked.columns else []
    who = label(inline)
    shown = F.concat(
        F.lit("Bundle #"), F.col("index").cast("string"), F.lit(" '"), who, F.lit("': "),
        F.col("error"),
    )
    none = F.lit(None)
    failed = checked.where(~F.col("valid")).select(
        *source,
        "index",
        who.alias("label"),
        F.lit(FAILED).alias("status"),
        none.cast("string").alias("report_id"),
        none.cast("int").alias("version"),
        F.lit(IN_PROCESS if inline else PRE_FAILED).alias("reason"),
        (F.col("error") if inline else shown).alias("error"),
    )
    done = routed.select(
        *source,
        "index",
        label(inline).alias("label"),
        "status",
        "report_id",
        "version",
        "reason",
        none.cast("string").alias("error"),
    )
    first = F.lit(0) if inline else F.when(F.col("status") == FAILED, 0).otherwise(1)
    return failed.unionByName(done).withColumn(
        "position", F.struct(first.alias("group"), F.col("index"))
    )


def summary(details: DataFrame) -> DataFrame:
    """Counters of a batch. Updates that wrote nothing count as updates."""
    return details.agg(
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in (CREATED, UPDATED, SKIPPED, FAILED)
        ],
        F.count("*").alias("total"),
    )


def errors(details: DataFrame) -> DataFrame:
    """The error lines of a batch, as rows: their number is not bounded."""
    return details.where(F.col("status") == FAILED).select(
        "index",
        F.when(
            F.col("reason") == IN_PROCESS,
            F.concat(F.lit("Bundle '"), F.col("label"), F.lit("': "), F.col("error")),
        )
        .otherwise(F.col("error"))
        .alias("message"),
    )
