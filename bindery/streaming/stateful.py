"""Routing on a stream, with the state of every key kept by Spark.

`streaming.ingest` routes each micro-batch against the stored registry and takes
hot keys apart. Here the last state of each key (version, checksums, report id)
lives in the state store of the query, so that a micro-batch reads and shuffles
nothing but its own rows: the choice where many small micro-batches meet a large
registry. The rows of one key in one micro-batch go to one task; bound them by
the size of a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bindery.functions import fingerprint as fp
from bindery.operators.facts import content_facts
from bindery.operators.route import REASON_CHANGED, REASON_NEW, REASON_SAME, base_rows
from bindery.schemas import CREATED, FILE_TYPES, KEY4, SKIPPED, UPDATED
from bindery.sources import inline

_SUMS = ("json_sum", "sql_sum", "tpl_sum")
STATE = "report_id string, version int, " + ", ".join(f"{s} string" for s in _SUMS)
OUTCOME = (
    "seq long, csi_id string, region string, regulation string, json_name string, "
    "status string, reason string, report_id string, version int, is_new_version boolean"
)


#: Outcomes that leave as one row: a key with more of them yields several.
PACKED_ROWS = 10_000


def _routed_key(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """The rows of one key in order, against what the rows before have left behind.

    Most keys have a few rows, so what counts is the cost of a call: rows come and
    go packed in one column of JSON, and no data frame is worked on.
    """
    rows = [json.loads(text) for frame in frames for text in frame["bundle"]]
    rows.sort(key=lambda r: ("seq" not in r, r.get("seq")))
    base = rows[0]
    if state.exists:
        report_id, version, *held = state.get
    elif "base_version" in base:
        report_id, version = base.get("base_report"), base["base_version"]
        held = [base.get(f"base_{s}") for s in _SUMS]
    else:
        report_id, version, held = base["own_id"], 0, [None] * 3
    named = dict(zip(KEY4, key, strict=True)) | {"report_id": report_id}
    routed = []
    for row in rows:
        sums = [row.get(s) for s in _SUMS]
        differs = [(own or "") != (last or "") for own, last in zip(sums, held, strict=True)]
        changed = ", ".join(f for f, d in zip(FILE_TYPES, differs, strict=True) if d)
        first = version == 0
        new = first or differs[0] or differs[1] or (differs[2] and sums[2] is not None)
        version += new
        held = [last if own is None else own for own, last in zip(sums, held, strict=True)]
        status, reason = (
            (CREATED, REASON_NEW) if first
            else (UPDATED, REASON_CHANGED + changed) if changed
            else (SKIPPED, REASON_SAME)
        )
        routed.append(
            named | {"seq": row.get("seq"), "status": status, "reason": reason, "version": version,
                     "is_new_version": new}
        )
        if len(routed) == PACKED_ROWS:
            yield pd.DataFrame({"routed": [json.dumps(routed)]})
            routed = []
    if routed:
        yield pd.DataFrame({"routed": [json.dumps(routed)]})
    state.update((report_id, version, *held))


def route_stateful(
    facts: DataFrame, active: DataFrame | None = None, batch_id: str = "0"
) -> DataFrame:
    """Route a stream of bundles, known by their facts; columns as in OUTCOME.

    Rules are those of `route`; bundles of a key are taken by `seq` within a
    micro-batch, and micro-batches one after another. `active` gives the state to
    begin with: the versions that are active when the query starts, met by a
    stream-static join and looked at where a key has no state of its own yet.
    """
    rows = facts.select("seq", *KEY4, *_SUMS, fp.report_id(KEY4, batch_id, "seq").alias("own_id"))
    names = {"_base_report": "base_report", "_base_version": "base_version"}
    names |= {s: f"base_{s}" for s in _SUMS}
    if active is None:
        none = F.lit(None)
        rows = rows.withColumns(
            {n: none.cast("int" if n == "base_version" else "string") for n in names.values()}
        )
    else:
        held = base_rows(active).select(
            *[F.col(k).alias(f"_of_{k}") for k in KEY4],
            *[F.col(old).alias(new) for old, new in names.items()],
        )
        same = F.lit(True)
        for k in KEY4:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        rows = rows.join(held, same, "left").drop(*[f"_of_{k}" for k in KEY4])
    packed = F.to_json(F.struct(*[c for c in rows.columns if c not in KEY4])).alias("bundle")
    done = rows.select(*KEY4, packed).groupBy(*KEY4).applyInPandasWithState(
        _routed_key, "routed string", STATE, "append", GroupStateTimeout.NoTimeout
    )
    return done.select(F.inline(F.from_json("routed", f"array<struct<{OUTCOME}>>")))


def start_stateful_route(
    requests: DataFrame,
    target: str,
    checkpoint: str,
    active: DataFrame | None = None,
    batch_id: str = "0",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Pushed bundles to a table of outcomes. State and sink commit together with
    the checkpoint, so a query that starts again goes on where it was, and no
    bundle counts twice."""
    facts = content_facts(inline.decode_bundles(requests))
    return (
        route_stateful(facts, active, batch_id)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
