"""Layered checks of bundles, each one an expression over the row.

A bundle row has `index`, `csi_id`, `region`, `regulation`, the paths or names
`json_config`, `sql_file` and `template`, and what `facts` found out about the
contents: sizes (null where there is no such file) and findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindery.functions import fingerprint as fp, text
from bindery.functions.config_json import NO_NAME, NO_REPORT, NOT_JSON, NOT_UTF8
from bindery.schemas import FAILED

# Required fields, and which layers each way in applies.
REQUIRED = ("csi_id", "region", "regulation", "json_config", "sql_file")
TOKENS = ("csi_id", "region", "regulation")
FIELDS, TOKEN, FILES, EXTENSIONS, SQL, CONFIG, REQUEST = (
    "fields", "tokens", "files", "extensions", "sql", "config", "request",
)
PROFILES = {
    "manifest": (FIELDS, TOKEN, FILES, EXTENSIONS, SQL, CONFIG),
    "inline": (REQUEST, CONFIG, SQL),
    "create": (REQUEST, CONFIG),
    "patch": (CONFIG,),
}
# Fields that a pushed bundle must bring, and the columns that tell.
PUSHED = {
    "csi_id": "csi_id",
    "region": "region",
    "regulation": "regulation",
    "json_config_filename": "json_config",
    "json_config_content": "json_size",
    "sql_file_filename": "sql_file",
    "sql_file_content": "sql_size",
}


def _steps() -> dict[str, Column]:
    """Columns that several messages share, worked out once per row."""
    return {
        "_lead": F.concat(F.lit("Bundle #"), F.col("index").cast("string")),
        "_has_template": F.coalesce(F.col("template") != "", F.lit(False)),
        "_sql_ext": fp.suffix(F.col("sql_file")),
        "_tpl_ext": fp.suffix(F.col("template")),
        "_sql_name": fp.basename(F.col("sql_file")),
        "_config_name": fp.basename(F.col("json_config")),
    }


def _says(*parts: str | Column) -> Column:
    """Message after the `Bundle #i` lead; strings are literal text."""
    return F.concat(F.col("_lead"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _fields(typed: bool) -> list[Column]:
    """`typed`: a column `wrong_types` tells what stands in place of strings."""
    odd = {k: F.col("wrong_types")[k] if typed else F.lit(None).cast("string") for k in REQUIRED}
    each = [
        F.when(
            odd[k].isNotNull(), F.concat(F.lit(f"'{k}' must be a string, got "), odd[k])
        )
        .when(F.col(k).isNull(), f"missing required key '{k}'")
        .when(text.is_blank(F.col(k)), f"'{k}' must not be blank")
        for k in REQUIRED
    ]
    # No findings make an empty text, and that a null message.
    errors = F.nullif(F.concat_ws("; ", *each), F.lit(""))
    csi = F.coalesce("csi_id", F.lit("?"))
    return [_says(" (csi_id=", csi, "): validation failed — ", errors)]


def _request(undecodable: bool) -> list[Column]:
    """Fields without a value; a content that can't be decoded is not missing."""
    given = F.col("undecodable").isNotNull() if undecodable else F.lit(False)
    each = [
        F.when(
            F.col(c).isNull() & ~(given if c.endswith("_size") else F.lit(False)),
            f"missing required field '{field}'",
        )
        for field, c in PUSHED.items()
    ]
    return [_says(": ", F.nullif(F.concat_ws("; ", *each), F.lit("")))]


def _tokens() -> list[Column]:
    allowed = "(only letters, digits, hyphens, underscores, dots allowed)"
    return [
        F.when(
            ~text.is_token(F.col(k)),
            _says(f": '{k}' contains invalid characters {allowed}: '", F.col(k), "'"),
        )
        for k in TOKENS
    ]


def _files(listed: bool) -> list[Column]:
    """`listed`: columns *_kind tell what is at a path, if anything."""

    def check(label: str, path: str, short: str) -> Column:
        size = F.col(f"{short}_size")
        kind = F.col(f"{short}_kind") if listed else F.lit("file")
        absent = kind.isNull() if listed else size.isNull()
        return (
            F.when(absent, _says(f": {label} not found: ", F.col(path)))
            .when(kind != "file", _says(f": {label} path is not a regular file: ", F.col(path)))
            .when(size == 0, _says(f": {label} is empty (0 bytes): ", F.col(path)))
        )

    return [
        check("JSON config", "json_config", "json"),
        check("SQL file", "sql_file", "sql"),
        F.when(F.col("_has_template"), check("Template", "template", "tpl")),
    ]


def _extensions() -> list[Column]:
    sql, tpl = F.col("_sql_ext"), F.col("_tpl_ext")
    shown = "{" + ", ".join(f"'{e}'" for e in text.TEMPLATE_EXTENSIONS) + "}"
    return [
        F.when(
            ~sql.isin(*text.SQL_EXTENSIONS),
            _says(": SQL file must have extension {'.sql'}, got '", sql, "'"),
        ),
        F.when(
            F.col("_has_template") & ~tpl.isin(*text.TEMPLATE_EXTENSIONS),
            _says(": Template file extension '", tpl, f"' is not in allowed set {shown}"),
        ),
    ]


def _sql() -> list[Column]:
    # Null in a part of a message makes it null: no finding, no message.
    return [_says(": ", F.col("sql_finding"), ": ", F.col("_sql_name"))]


def _config() -> list[Column]:
    name, finding = F.col("_config_name"), F.col("json_finding")
    ext = F.regexp_extract(name, r"(?s).+(\.[^.]+)$", 1)
    rest = (
        F.when(finding == NOT_JSON, F.concat(F.lit(f": {NOT_JSON} in "), name))
        .when(finding == NOT_UTF8, F.concat(F.lit(f": {NOT_UTF8}: "), name))
        .when(
            finding.isin(NO_REPORT, NO_NAME),
            F.concat(F.lit(": JSON config '"), name, F.lit("' "), finding),
        )
        .otherwise(F.concat(F.lit(": "), finding))
    )
    said = (
        F.when(
            F.lower(ext) != text.CONFIG_EXTENSION,
            F.concat(F.lit(": JSON config must be a .json file, got: '"), ext, F.lit("'")),
        )
        .when(F.col("json_size") == 0, F.concat(F.lit(": JSON config is empty: "), name))
        .otherwise(rest)
    )
    return [_says(said)]


def validate(
    bundles: DataFrame, profile: str = "manifest", layers: tuple[str, ...] | None = None
) -> DataFrame:
    """Add `valid`, the first `error`, and all `errors`.

    Rows are never dropped, so one bad bundle does not hold up the others.
    """
    checks = {
        FIELDS: lambda: _fields("wrong_types" in bundles.columns), TOKEN: _tokens,
        FILES: lambda: _files("json_kind" in bundles.columns), EXTENSIONS: _extensions, SQL: _sql,
        CONFIG: _config, REQUEST: lambda: _request("undecodable" in bundles.columns),
    }
    found = [c for layer in layers or PROFILES[profile] for c in checks[layer]()]
    if "is_mapping" in bundles.columns:
        no_map = F.when(~F.col("is_mapping"), _says(": must be a mapping/dict"))
        found = [no_map] + [F.when(F.col("is_mapping"), c) for c in found]
    # Messages differ, so taking out null takes out nothing else; unlike a
    # filter with a lambda this stays within generated code.
    steps = _steps()
    no_message = F.array(F.lit(None).cast("string"))
    return (
        bundles.withColumns(steps)
        .withColumn("errors", F.array_except(F.array(*found), no_message))
        .withColumn("error", F.get("errors", F.lit(0)))
        .withColumn("valid", F.col("error").isNull())
        .drop(*steps)
    )


# What can be wrong with a manifest as a whole.
NO_BUNDLES = "missing required top-level key 'bundles'"
EMPTY_BUNDLES = "'bundles' list is empty — nothing to seed"


def validate_manifests(manifests: DataFrame, source: str = "source") -> DataFrame:
    """Per manifest: number of entries, and what is wrong with its list."""
    found = F.when(F.col("bundles").isNull(), NO_BUNDLES).when(F.size("bundles") == 0, EMPTY_BUNDLES)
    if "parse_error" in manifests.columns:
        found = F.coalesce("parse_error", found)
    lead = F.concat(F.col(source).cast("string"), F.lit(": "))
    return manifests.withColumn("error", F.concat(lead, found)).withColumn(
        "n_bundles", F.coalesce(F.size("bundles"), F.lit(0))
    )


def manifest_outcomes(manifests: DataFrame) -> DataFrame:
    """Outcome rows of manifests that fail as a whole; they have no index."""
    bad = validate_manifests(manifests).where(F.col("error").isNotNull())
    return bad.select(
        "source", F.lit(None).cast("long").alias("index"), F.col("source").alias("label"),
        F.lit(FAILED).alias("status"), F.lit("Manifest failed").alias("reason"), "error",
    )
