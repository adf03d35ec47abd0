"""Manifests: JSON or Parquet rows, or many small YAML files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindery.schemas import MANIFEST_ENTRY

MANIFEST = f"source string, bundles array<{MANIFEST_ENTRY.simpleString()}>"
_FIELDS = MANIFEST_ENTRY.fieldNames()
# An entry with what it holds in place of a string; null where all is well.
_TYPED = MANIFEST_ENTRY.simpleString()[:-1] + ",wrong_types:map<string,string>>"
TYPED_MANIFEST = f"source string, bundles array<{_TYPED}>, parse_error string"

# What is wrong with a manifest before its entries are looked at,
# and the names of types in messages.
NOT_PARSED = "Failed to parse YAML manifest: "
NOT_MAPPING = "YAML root must be a mapping, got "
NO_KEY = "missing required top-level key 'bundles'"
NOT_LIST = "'bundles' must be a YAML list, got "
TYPE_NAMES = {
    "VOID": "null", "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "DOUBLE": "float",
}


def _type_name(value: Column) -> Column:
    """Name of a variant's type, as messages have it."""
    kind = F.schema_of_variant(value)
    named = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return (
        F.when(kind.startswith("OBJECT"), "dict")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("DECIMAL"), "float")
        .otherwise(F.coalesce(named[kind], F.lower(kind)))
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, in the layout of `TYPED_MANIFEST`.

    Read as variants, so that a number or a flag is told from a string. A file
    that is no manifest comes with a `parse_error` and without entries.
    """
    docs = spark.read.text(path, wholetext=True)
    docs = docs.select(F.input_file_name().alias("source"), F.try_parse_json("value").alias("root"))
    docs = docs.withColumn("list", F.try_variant_get("root", "$.bundles", "variant"))
    kind = F.schema_of_variant("list")

    def field(entry: Column, name: str) -> Column:
        value = F.try_variant_get(entry, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(entry, f"$.{name}", "string"))

    def wrong(entry: Column) -> Column:
        pairs = []
        for name in _FIELDS:
            value = F.try_variant_get(entry, f"$.{name}", "variant")
            odd = ~F.schema_of_variant(value).isin("STRING", "VOID")
            pairs.append(F.when(odd, F.struct(F.lit(name).alias("k"), _type_name(value).alias("v"))))
        found = F.filter(F.array(*pairs), lambda x: x.isNotNull())
        return F.when(F.size(found) > 0, F.map_from_entries(found))

    def entry(raw: Column) -> Column:
        own = [field(raw, name).alias(name) for name in _FIELDS]
        is_map = F.schema_of_variant(raw).startswith("OBJECT")
        return F.when(is_map, F.struct(*own, wrong(raw).alias("wrong_types")))

    entries = F.transform(F.try_variant_get("root", "$.bundles", "array<variant>"), entry)
    error = (
        F.when(F.col("root").isNull(), F.lit(f"{NOT_PARSED}not valid JSON"))
        .when(
            ~F.schema_of_variant("root").startswith("OBJECT"),
            F.concat(F.lit(NOT_MAPPING), _type_name(F.col("root"))),
        )
        .when(F.col("list").isNull(), NO_KEY)
        .when(~kind.startswith("ARRAY"), F.concat(F.lit(NOT_LIST), _type_name(F.col("list"))))
    )
    return docs.select("source", entries.alias("bundles"), error.alias("parse_error"))


def read_yaml(spark: SparkSession, path: str, glob: str = "*.y*ml") -> DataFrame:
    """YAML files, each read within a task; `parse_error` tells of broken ones."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "content")
    )
    return files.mapInPandas(_parse_yaml, TYPED_MANIFEST)


def _parse_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML manifests needs PyYAML on the executors") from exc

    def entry(raw: object) -> dict | None:
        if not isinstance(raw, dict):
            return None
        known = {f: raw.get(f) for f in _FIELDS}
        odd = {
            f: type(v).__name__ for f, v in known.items() if v is not None and not isinstance(v, str)
        }
        return {f: None if f in odd else v for f, v in known.items()} | {"wrong_types": odd or None}

    def parse(content: bytes) -> tuple[list | None, str | None]:
        try:
            root = yaml.safe_load(bytes(content).decode("utf-8"))
        except (yaml.YAMLError, UnicodeDecodeError) as exc:
            return None, f"{NOT_PARSED}{exc}"
        if not isinstance(root, dict):
            return None, f"{NOT_MAPPING}{type(root).__name__}"
        if "bundles" not in root:
            return None, NO_KEY
        bundles = root["bundles"]
        if not isinstance(bundles, list):
            return None, f"{NOT_LIST}{'null' if bundles is None else type(bundles).__name__}"
        return [entry(b) for b in bundles], None

    for batch in batches:
        parsed = [parse(c) for c in batch["content"]]
        yield pd.DataFrame(
            {
                "source": batch["path"],
                "bundles": [p[0] for p in parsed],
                "parse_error": [p[1] for p in parsed],
            }
        )


def entries(manifests: DataFrame) -> DataFrame:
    """One row per manifest entry, numbered from 0; null entries are kept."""
    return manifests.select("source", F.posexplode("bundles").alias("index", "b")).select(
        "source", "index", F.col("b").isNotNull().alias("is_mapping"), "b.*"
    )


def numbered(entries: DataFrame) -> DataFrame:
    """Add `seq`, rising by source and index: the order in which to take entries.

    Range partitions are numbered on their own, so no task sees all rows. Write
    the result out before using it twice.
    """
    rows = entries.repartitionByRange("source", "index").sortWithinPartitions("source", "index")
    return rows.withColumn("seq", F.monotonically_increasing_id())
