"""Checksums, identifiers and file-name helpers, all as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Checksum text form and content types by extension.
CHECKSUM_PREFIX = "sha256:"
CONFIG_CONTENT_TYPE = "application/json"
DEFAULT_CONTENT_TYPE = "application/octet-stream"
CONTENT_TYPES = {
    ".csv": "text/csv",
    ".html": "text/html",
    ".json": "application/json",
    ".sql": "application/sql",
    ".txt": "text/plain",
    ".xml": "text/xml",
}


def checksum(content: Column) -> Column:
    """`sha256:` and 64 hex digits; null for null content."""
    return F.when(content.isNotNull(), F.concat(F.lit(CHECKSUM_PREFIX), F.sha2(content, 256)))


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """Extension in lower case with its dot; empty if there is none.

    A leading dot does not start an extension (`.sql` has none), nor does a
    trailing dot.
    """
    return F.lower(F.regexp_extract(basename(name), r"(?s).+(\.[^.]+)$", 1))


def content_type(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(known[suffix(name)], F.lit(DEFAULT_CONTENT_TYPE))


def report_id(keys: Sequence[str | Column], batch_id: str | Column, seq: str | Column) -> Column:
    """Identifier of the record created by row `seq` of a batch.

    UUID-shaped (version 8, the custom one) but derived from the creating row,
    so that a task that is run again after a lost executor gives the same id.
    The batch and row take part because a patch can rename a record away from
    its key, after which the key can be created afresh.
    """
    batch = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    row = F.col(seq) if isinstance(seq, str) else seq
    digest = F.sha2(F.concat_ws("|", *parts, batch, row.cast("string")), 256)
    shape = r"^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$"
    return F.regexp_replace(digest, shape, "$1-$2-8$3-a$4-$5")
