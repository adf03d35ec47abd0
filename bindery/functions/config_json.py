"""Reading `report.name` out of a config, and saying why it cannot be read."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bindery.functions.text import is_blank

# The findings about a config, from the outermost inwards.
NOT_UTF8 = "JSON config file is not valid UTF-8"
NOT_JSON = "Invalid JSON"
NOT_OBJECT = "JSON config root must be a JSON object"
NO_REPORT = "missing required 'report' object"
NO_NAME = "missing required field 'report.name'"


def with_native_facts(df: DataFrame, body: Column, out: str) -> DataFrame:
    """Add struct `out` of `finding` and `name`, worked out inside the JVM.

    The text is parsed once, in a step of its own. Differs from `strict_config`
    for rare texts only: NaN and duplicate keys are refused. The text is parsed as
    the only element of a list, so whatever follows its closing brace breaks it.
    """
    name = F.when(F.schema_of_variant("_name") == "STRING", F.expr("CAST(_name AS STRING)"))
    finding = (
        F.when(~F.is_valid_utf8("_body"), NOT_UTF8)
        .when(F.col("_root_type").isNull(), NOT_JSON)
        .when(~F.col("_root_type").startswith("OBJECT<"), NOT_OBJECT)
        .when(~F.coalesce(F.col("_report_type").startswith("OBJECT<"), F.lit(False)), NO_REPORT)
        .when(F.coalesce(is_blank(F.col("_name_text")), F.lit(True)), NO_NAME)
    )
    return (
        df.withColumn("_body", body)
        .withColumn("_list", F.try_parse_json(F.concat(F.lit("["), "_body", F.lit("\n]"))))
        .withColumn(
            "_root",
            F.when(
                F.try_variant_get("_list", "$[1]", "variant").isNull(),
                F.try_variant_get("_list", "$[0]", "variant"),
            ),
        )
        .withColumns(
            {
                "_root_type": F.schema_of_variant("_root"),
                "_report_type": F.schema_of_variant(
                    F.try_variant_get("_root", "$.report", "variant")
                ),
                "_name": F.try_variant_get("_root", "$.report.name", "variant"),
            }
        )
        .withColumn("_name_text", name)
        .withColumn(out, F.struct(finding.alias("finding"), F.col("_name_text").alias("name")))
        .drop("_body", "_list", "_root", "_root_type", "_report_type", "_name", "_name_text")
    )


_FACTS = T.StructType(
    [T.StructField("finding", T.StringType()), T.StructField("name", T.StringType())]
)


@F.pandas_udf(_FACTS)
def strict_config(content: pd.Series) -> pd.DataFrame:
    """Exact JSON reading for configs with NaN, duplicate keys or trailing text."""

    def read(raw: bytes | None) -> tuple[str | None, str | None]:
        try:
            doc = json.loads(bytes(raw or b"").decode("utf-8"))
        except UnicodeDecodeError:
            return NOT_UTF8, None
        except (ValueError, RecursionError):
            return NOT_JSON, None
        if not isinstance(doc, dict):
            return NOT_OBJECT, None
        if not isinstance(doc.get("report"), dict):
            return NO_REPORT, None
        name = doc["report"].get("name")
        if not isinstance(name, str) or not name.strip():
            return NO_NAME, None
        return None, name

    return pd.DataFrame([read(c) for c in content], columns=["finding", "name"])
