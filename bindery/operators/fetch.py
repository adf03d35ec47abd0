"""Lookups, listings and pages over versions that carry `active`.

Every filter is a plain predicate on a stored column, so it reaches the scan.
Where the result is limited the order is total, so a page is reproducible.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import text
from bindery.session import written
from bindery.schemas import KEY3

# Default and highest numbers of rows.
DEFAULT_LIMIT = 500
PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000

FILTERS = (*KEY3, "report_id")
PAGE_ORDER = (*KEY3, "report_id", "version")
LISTED = ("report_id", *KEY3, "name", "version", "uploaded_at")


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows; no limit means all, and so does zero, as document stores have it."""
    return df.orderBy(*PAGE_ORDER).limit(limit) if limit else df


def matching(
    versions: DataFrame, filters: Mapping[str, str | None] | None = None, active_only: bool = True
) -> DataFrame:
    """AND of equalities. Unknown names and empty values do not filter."""
    out = versions.where("active") if active_only else versions
    for name, value in (filters or {}).items():
        if name in FILTERS and value:
            out = out.where(F.col(name) == value)
    return out


def fetch(
    versions: DataFrame,
    filters: Mapping[str, str | None] | None = None,
    active_only: bool = True,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    return _limited(matching(versions, filters, active_only), limit)


def by_csi_id(versions: DataFrame, csi_id: str, **kw) -> DataFrame:
    return fetch(versions, {"csi_id": csi_id}, **kw)


def by_region(versions: DataFrame, region: str, **kw) -> DataFrame:
    return fetch(versions, {"region": region}, **kw)


def by_regulation(versions: DataFrame, regulation: str, **kw) -> DataFrame:
    return fetch(versions, {"regulation": regulation}, **kw)


def list_active(versions: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    return fetch(versions, limit=limit).select(*LISTED)


def list_all(versions: DataFrame) -> DataFrame:
    return versions.select(*LISTED, "active")


def of_reports(versions: DataFrame, requested: DataFrame) -> DataFrame:
    """Versions of the requested reports, before anything is worked out about them.

    Chains stay whole, as a report id stays along its chain.
    """
    return versions.join(requested.select("report_id").distinct(), "report_id", "left_semi")


def by_report_ids(versions: DataFrame, requested: DataFrame) -> DataFrame:
    """The active version of each requested report, with a `found` flag."""
    active = versions.where("active").withColumn("found", F.lit(True))
    return (
        requested.select("report_id")
        .distinct()
        .join(active, "report_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def by_report_version(versions: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows for (report_id, version) requests; a null version asks for the active one.

    Each kind of request is its own equi-join, so that neither turns into a
    join on an OR.
    """
    exact = requested.where(F.col("version").isNotNull()).select("report_id", "version").distinct()
    latest = requested.where(F.col("version").isNull()).select("report_id").distinct()
    cols = [c for c in versions.columns if c not in ("report_id", "version")]
    found = F.lit(True).alias("found")
    hit = versions.select("report_id", "version", *cols, found)
    by_version = exact.join(hit, ["report_id", "version"], "left").withColumn(
        "asked_version", F.col("version")
    )
    by_active = latest.join(hit.where("active"), "report_id", "left").withColumn(
        "asked_version", F.lit(None).cast("int")
    )
    return by_version.unionByName(by_active).withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def page(
    versions: DataFrame,
    filters: Mapping[str, str | None] | None = None,
    active_only: bool = True,
    limit: int = PAGE_SIZE,
    skip: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """One page and, as a one-row frame, the number of rows before paging."""
    if limit > MAX_PAGE_SIZE or skip < 0:
        raise ValueError(f"limit must not exceed {MAX_PAGE_SIZE} and skip must not be negative")
    rows = matching(versions, filters, active_only)
    total = rows.agg(F.count("*").alias("total"))
    # A limit of zero means no limit, as document stores have it.
    ordered = rows.orderBy(*PAGE_ORDER).offset(skip)
    return (ordered.limit(limit) if limit else ordered), total


def deep_page(
    rows: DataFrame, limit: int = PAGE_SIZE, skip: int = 0, ranges: int = 64
) -> DataFrame:
    """The same page where `skip` is large, without a task that sorts what is skipped.

    The sort columns alone are dealt to ranges and stored; each range is counted,
    and the one or few that hold the page are sorted. The rows behind its keys are
    then joined, at most `limit` of them. Choose `ranges` so that one fits a task.
    """
    if limit < 1 or skip < 0:
        raise ValueError("limit must be positive and skip must not be negative")
    dealt = rows.select(*PAGE_ORDER).repartitionByRange(ranges, *PAGE_ORDER)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dict(dealt.groupBy("_range").count().collect())  # one number for each range
    before, wanted, first = 0, [], 0
    for number in sorted(counts):
        if before < skip + limit and before + counts[number] > skip:
            if not wanted:
                first = before
            wanted.append(number)
        before += counts[number]
    keys = dealt.where(F.col("_range").isin(wanted)).drop("_range")
    keys = keys.orderBy(*PAGE_ORDER).offset(skip - first).limit(limit)
    same = F.lit(True)
    for name in PAGE_ORDER:
        same = same & rows[name].eqNullSafe(F.col(f"_of_{name}"))
    keys = keys.distinct().withColumnsRenamed({name: f"_of_{name}" for name in PAGE_ORDER})
    return rows.join(F.broadcast(keys), same, "left_semi").orderBy(*PAGE_ORDER)


def page_after(rows: DataFrame, last: Mapping[str, object], limit: int = PAGE_SIZE) -> DataFrame:
    """The page after a known last row: a filter in place of a deep offset."""
    after: Column = F.lit(False)
    for i, name in enumerate(PAGE_ORDER):
        step = F.col(name) > F.lit(last[name])
        for same in PAGE_ORDER[:i]:
            step = step & (F.col(same) == F.lit(last[same]))
        after = after | step
    return rows.where(after).orderBy(*PAGE_ORDER).limit(limit)


def as_json(versions: DataFrame) -> DataFrame:
    """Each version as one JSON document with ISO timestamps and an `id`."""
    record_id = F.concat_ws("_v", "report_id", F.col("version").cast("string"))
    log = F.transform(
        "audit_log",
        lambda e: F.struct(
            e["action"].alias("action"),
            text.iso_utc(e["timestamp"]).alias("timestamp"),
            e["details"].alias("details"),
        ),
    )
    doc = F.struct(
        record_id.alias("id"), "report_id", *KEY3, "name", "original_files", "file_contents",
        "checksums", "file_sizes", text.iso_utc(F.col("uploaded_at")).alias("uploaded_at"),
        "active", "version", log.alias("audit_log"),
    )
    return versions.select(
        "report_id", "version", F.to_json(doc, {"ignoreNullFields": "false"}).alias("record")
    )


def listing_view(versions: DataFrame) -> DataFrame:
    """Display form of a listing, the upload time to the minute."""
    return versions.select(
        "report_id", *KEY3, "name", "version", "active",
        F.date_format("uploaded_at", text.MINUTE_FORMAT).alias("uploaded"),
    )


def detail_view(versions: DataFrame) -> DataFrame:
    """Display form of one record: a line per file with its size and checksum."""

    def line(file: str) -> Column:
        size = F.coalesce(F.col(f"file_sizes.{file}"), F.lit(0)).cast("string")
        name = F.coalesce(f"original_files.{file}", F.lit("N/A"))
        return F.concat(name, F.lit(" ("), size, F.lit(" bytes)"))

    files = ("json_config", "template", "sql_file")
    return versions.select(
        "report_id", *KEY3, "name", "version", "active",
        *[line(f).alias(f) for f in files],
        *[F.coalesce(f"checksums.{f}", F.lit("N/A")).alias(f"{f}_checksum") for f in files],
    )
