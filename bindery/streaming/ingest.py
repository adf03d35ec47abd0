"""Continuous ingestion of pushed bundles, and the audit feed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bindery.plans.ingest import ingest_requests
from bindery.plans.registry import Registry
from bindery.schemas import AUDIT, INLINE_BUNDLE


def read_landing(spark, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder into which request files (JSON lines) are dropped."""
    reader = spark.readStream.schema(INLINE_BUNDLE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def start_ingest(
    requests: DataFrame,
    registry: Registry,
    checkpoint: str,
    batch_prefix: str = "stream",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Run every micro-batch through the batch pipeline.

    The checkpoint and the micro-batch number name the registry batch. A
    micro-batch that Spark runs again after a failure thus replaces what its
    first try wrote, or is left alone if that had ended: each bundle counts once.
    Another stream, or the same one begun afresh, has another checkpoint and so
    batches of its own.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def one(rows: DataFrame, number: int) -> None:
        ingest_requests(registry, rows, f"{batch_prefix}-{stream}-{number}", **options)

    return (
        requests.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_audit(registry: Registry) -> DataFrame:
    """The audit table as a stream of appended rows. Files are only ever added to that
    table, neither purges nor batches that are run again write an entry twice, so a
    stream that goes on, or starts again, sees each entry once."""
    path = f"{registry.root}/audit"
    return registry.spark.readStream.schema(AUDIT).parquet(f"{path}/batch_id=*")


def start_audit_feed(
    registry: Registry, target: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append an audit row for every event of every new version. Stateless."""
    return (
        read_audit(registry)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
