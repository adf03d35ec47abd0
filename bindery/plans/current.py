"""The active versions of a registry, kept by deltas, so that a batch reads few of them.

    current/epoch=E/batch_id=.base/bucket=K   active versions when the epoch began
    current/epoch=E/batch_id=B/bucket=K       newest version of each report batch B changed
    epochs/                                   the last row describes the current epoch

The bucket of a record is a hash of its KEY3, which never changes. A batch knows
the buckets it touches, at most all of them, and reads those alone: whatever the
size of the registry, what it reads follows its own keys. Every `DELTAS` batches
the deltas are folded into a new epoch; so are purges. An epoch counts from its
row in `epochs`, and what a broken-off fold has written is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, Row, SparkSession, types as T, functions as F

from bindery.operators.chain import active_versions
from bindery.schemas import KEY3, VERSIONS
from bindery.session import compressed

#: Choose buckets so that one holds some 100,000 active versions.
BUCKETS, DELTAS = 16, 32
#: No batch id begins with a dot.
BASE = ".base"

#: Row groups small enough to skip, and columns that lookups name.
ROW_GROUP = 8 << 20
LOOKED_UP = ("report_id", *KEY3)

EPOCH = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("batches", T.LongType()),
        T.StructField("generation", T.IntegerType()),
    ]
)
_PLACED = T.StructType(
    [
        *VERSIONS.fields,
        T.StructField("batch_id", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def _sorted(rows: DataFrame, folder: str | None) -> DataFrameWriter:
    """Writer of rows sorted by report id, below folders named by a column if given.
    The one sort begins with that column, so the writer need not sort again."""
    folders = [folder] if folder else []
    rows = rows.sortWithinPartitions(*folders, "report_id", "version")
    return compressed(rows.write).mode("overwrite").partitionBy(*folders)


def for_lookups(
    rows: DataFrame, folder: str | None = None, row_group: int = ROW_GROUP
) -> DataFrameWriter:
    """Writer of version rows that serves point lookups.

    Sorted by report id within each file, so its row groups have narrow ranges,
    with Bloom filters for equality on the report id and the parts of KEY3. A
    lookup reads the row groups that may hold what it asks for.
    """
    writer = _sorted(rows, folder).option("parquet.block.size", row_group)
    for column in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.adaptive.enabled#{column}", "true")
    return writer


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY3), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class CurrentState:
    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def epoch(self) -> Row:
        try:
            rows = self.spark.read.schema(EPOCH).parquet(f"{self.root}/epochs")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return Row(epoch=0, buckets=self.buckets, batches=0, generation=0)
        return rows.orderBy(F.desc("epoch")).first()

    def _path(self, epoch: int) -> str:
        return f"{self.root}/current/epoch={epoch}"

    def _write(self, rows: DataFrame, epoch: int, buckets: int, batch_id: str) -> None:
        rows = rows.select(*VERSIONS.fieldNames(), bucket_of(buckets).alias("bucket"))
        rows = rows.repartition("bucket")
        path = f"{self._path(epoch)}/batch_id={batch_id}"
        # Read by whole buckets and never by an equality, so without Bloom filters.
        _sorted(rows, "bucket").parquet(path)

    def add(self, versions: DataFrame, batch_id: str) -> None:
        """The delta of a batch; replaces what an earlier try has written."""
        now = self.epoch()
        self._write(active_versions(versions), now.epoch, now.buckets, batch_id)

    def read(self, ended: DataFrame, touching: DataFrame | None = None) -> DataFrame:
        """Active versions after the batches `ended`, of the KEY3 groups `touching` names.

        At most as many numbers are fetched as there are buckets.
        """
        now = self.epoch()
        try:
            rows = self.spark.read.schema(_PLACED).parquet(self._path(now.epoch))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _PLACED).select(*VERSIONS.fieldNames())
        if touching is not None:
            keys = touching.select(*KEY3).distinct()
            asked = keys.select(bucket_of(now.buckets).alias("bucket")).distinct().collect()
            rows = rows.where(F.col("bucket").isin([r["bucket"] for r in asked]))
            rows = rows.join(keys, list(KEY3), "left_semi")
        base = self.spark.createDataFrame([(BASE,)], "batch_id string")
        rows = rows.join(ended.select("batch_id").union(base), "batch_id", "left_semi")
        return active_versions(rows.select(*VERSIONS.fieldNames()))

    def renew(self, active: DataFrame, batches: int, generation: int) -> None:
        """Begin an epoch with these active versions."""
        number = self.epoch().epoch + 1
        self._write(active, number, self.buckets, BASE)
        row = self.spark.createDataFrame([(number, self.buckets, batches, generation)], EPOCH)
        row.write.mode("append").parquet(f"{self.root}/epochs")
