"""Checks that take the place of unique indexes; each returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindery.operators.chain import unreplaced_versions
from bindery.schemas import KEY3


def several_active_per_report(versions: DataFrame) -> DataFrame:
    """Reports with more than one active version (a gap or a double write)."""
    return (
        unreplaced_versions(versions)
        .groupBy("report_id")
        .agg(F.count("*").alias("n_active"))
        .where("n_active > 1")
    )


def several_active_per_key(versions: DataFrame) -> DataFrame:
    """Composite keys held by more than one active version."""
    return (
        unreplaced_versions(versions)
        .groupBy(*KEY3, F.col("original_files.json_config").alias("json_name"))
        .agg(F.count("*").alias("n_active"))
        .where("n_active > 1")
    )


def broken_chains(versions: DataFrame) -> DataFrame:
    """Per report: lowest version below 1, gaps, repeats, or missing references.

    All are aggregates, combined before the shuffle. A chain may start above 1
    after retention; repeats are told by the distinct versions, so that a repeat
    does not make up for a gap.
    """
    missing = (
        F.col("file_contents.json_config_id").isNull() | F.col("file_contents.sql_file_id").isNull()
    )
    return (
        versions.groupBy("report_id")
        .agg(
            F.min("version").alias("first_version"),
            F.max("version").alias("last_version"),
            F.count("*").alias("n_versions"),
            F.count_distinct("version").alias("n_distinct"),
            F.count_if(missing).alias("missing_refs"),
        )
        .where(
            "first_version < 1 OR missing_refs > 0"
            " OR last_version - first_version + 1 <> n_distinct OR n_distinct <> n_versions"
        )
        .drop("n_distinct")
    )
