"""Everything the later steps need to know about file contents.

This is the one place that reads contents for ingestion. Checksum, size and
findings are taken in a single pass where the bytes lie; validation, routing
and all their joins and shuffles then work on these narrow columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import fingerprint as fp, text
from bindery.functions.config_json import strict_config, with_native_facts

# The findings about an SQL text.
SQL_NOT_UTF8 = "SQL file is not valid UTF-8"
SQL_BLANK = "SQL file contains only whitespace"


def sql_finding(content: Column) -> Column:
    return F.when(~text.is_utf8(content), SQL_NOT_UTF8).when(
        text.is_blank(content.cast("string")), SQL_BLANK
    )


def _with_config(df: DataFrame, content: Column, strict_json: bool) -> DataFrame:
    """Add `_config`, a struct of `finding` and `name`.

    `strict_json` reads the config in Arrow batches instead of inside the JVM,
    for exactness on NaN, duplicate keys and trailing text.
    """
    if strict_json:
        return df.withColumn("_config", strict_config(content))
    return with_native_facts(df, content.cast("string"), "_config")


def content_facts(bundles: DataFrame, strict_json: bool = False) -> DataFrame:
    """Replace the contents of bundles by what is to be known about them."""
    out = _with_config(bundles, F.col("json_content"), strict_json)
    out = out.withColumns(
        {
            "name": F.col("_config.name"),
            "json_finding": F.col("_config.finding"),
            "sql_finding": sql_finding(F.col("sql_content")),
        }
    )
    for short in ("json", "sql", "tpl"):
        content = F.col(f"{short}_content")
        out = out.withColumns(
            {f"{short}_sum": fp.checksum(content), f"{short}_size": fp.byte_size(content)}
        )
    return out.drop("_config", "json_content", "sql_content", "tpl_content")


def file_facts(files: DataFrame, strict_json: bool = False) -> DataFrame:
    """The same per file: `path`, `sum`, `size`, `finding` and config `name`.

    `files` has path and content, or comes from `listing.hashed` with sums that
    were taken as the file was read; then its `kind` goes along.
    """
    suffix = fp.suffix(F.col("path"))
    is_config = suffix == text.CONFIG_EXTENSION
    config = F.when(is_config, F.col("content"))
    known = "sum" in files.columns
    return _with_config(files, config, strict_json).select(
        "path",
        *(["kind"] if known else []),
        (F.col("sum") if known else fp.checksum(F.col("content")).alias("sum")),
        (F.col("size") if known else fp.byte_size(F.col("content")).alias("size")),
        F.when(is_config, F.col("_config.finding"))
        .when(suffix.isin(*text.SQL_EXTENSIONS), sql_finding(F.col("content")))
        .alias("finding"),
        F.when(is_config, F.col("_config.name")).alias("name"),
    )
