"""The stored registry: append-only tables in a shared folder.

    versions/generation=G/batch_id=B   version rows, no active flag
    blobs/batch_id=B                   contents by checksum
    dead_blobs/batch_id=B              ids of blobs of that batch that don't count any more
    outcomes/batch_id=B                what became of each row (one layout for all kinds)
    batches/batch_id=B                 fingerprint of the batch's input
    ended/batch_id=B                   the batch has ended: from here on it counts
    audit/batch_id=B                   audit entries, which no purge touches
    audited/batch_id=B                 all audit entries of the batch are there
    refs/batch_id=B                    how often the batch's versions refer to each blob
    unrefs/generation=G                the same of the versions that a purge took away
    generations/                       the last row names the current G
    current/, epochs/                  active versions in buckets, see `current`

A batch writes blobs, outcomes and versions, and then that it has ended. Readers
of versions and outcomes see batches that have ended, so one that breaks off
leaves nothing behind but blobs that nobody refers to, and may be run again at
any time. A batch that has ended is never done again: under its id the same
input returns its stored outcome, and another input is refused. Audit entries
follow the end of their batch; if that breaks off, the next writer adds those
that are missing, so each is written once. One batch at a time writes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from bindery.functions.text import utc_now
from bindery.operators import blobs as blob_ops, retention
from bindery.operators.chain import active_versions, audit_feed, with_successor
from bindery.plans.current import BUCKETS, DELTAS, CurrentState, for_lookups
from bindery.schemas import AUDIT, BLOBS, KEY3, OUTCOMES, VERSIONS
from bindery.session import compressed, written

_BATCH = [T.StructField("batch_id", T.StringType(), True)]
_REFS = T.StructType(
    [T.StructField("blob_id", T.StringType(), True), T.StructField("n", T.LongType(), True)]
)
_MARK = T.StructType([T.StructField("id", T.StringType(), True)])


@dataclass(frozen=True)
class Registry:
    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    @property
    def current(self) -> CurrentState:
        return CurrentState(self.spark, self.root, self.buckets)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        schema = T.StructType(schema.fields + _BATCH)
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        schema = T.StructType([T.StructField("generation", T.IntegerType())])
        path = f"{self.root}/generations"
        newest = self._read(path, schema).agg(F.max("generation")).first()[0]
        return newest or 0

    def _marked(self, table: str) -> DataFrame:
        return self._read(f"{self.root}/{table}", _MARK).select("batch_id").distinct()

    def _mark(self, table: str, batch_id: str) -> None:
        row = self.spark.createDataFrame([(batch_id,)], _MARK)
        row.write.mode("overwrite").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def _of_ended(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._marked("ended"), "batch_id", "left_semi").select(*rows.columns)

    def recover(self) -> None:
        """Add the audit entries of batches that broke off after their end."""
        pending = self._marked("ended").join(self._marked("audited"), "batch_id", "left_anti")
        for row in pending.collect():  # one at most, as every writer begins with this
            self._write_audit(row["batch_id"])
        self._fold()

    def _fold(self) -> None:
        """Begin a new epoch of the current state, if a purge or enough batches ask for it."""
        state, generation = self.current.epoch(), self.generation()
        batches = self._marked("ended").count()
        if state.generation != generation:
            self.current.renew(active_versions(self.versions()), batches, generation)
        elif batches - state.batches >= DELTAS:
            self.current.renew(self.current.read(self._marked("ended")), batches, generation)

    def _write_audit(self, batch_id: str) -> None:
        path = f"{self._versions_path(self.generation())}/batch_id={batch_id}"
        missing = audit_feed(self.spark.read.schema(VERSIONS).parquet(path))
        there = self.audit().where(F.col("batch_id") == batch_id)
        if not there.isEmpty():  # only after a break; as a rule entries are made map-only
            missing = missing.join(there, ["report_id", "version", "action"], "left_anti")
        compressed(missing.select(*AUDIT.fieldNames()).write).mode("append").parquet(
            f"{self.root}/audit/batch_id={batch_id}"
        )
        self._mark("audited", batch_id)

    def end(self, batch_id: str) -> None:
        """The batch counts from now on; then its audit entries are made."""
        self._mark("ended", batch_id)
        self._write_audit(batch_id)

    def begin(self, batch_id: str, rows: DataFrame) -> bool:
        """Enter a batch by the fingerprint of its input; refuse another input.

        True if the batch has ended before and is not to be done again. Ids name
        folders, so they are kept to letters, digits, dots, hyphens and underscores.
        """
        self.recover()
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]*", batch_id):
            raise ValueError(f"not usable as a batch id: {batch_id!r}")
        fields = sorted((f for f in rows.schema if f.name != "uploaded_at"), key=lambda f: f.name)
        one = F.xxhash64(
            *[
                F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
                for f in fields
            ]
        )
        mark = rows.select(one.alias("h")).agg(
            F.count("*").alias("n"),
            F.coalesce(F.bit_xor("h"), F.lit(0)).alias("bits"),
            F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum"),
        )
        own = mark.select(F.concat_ws(":", "n", "bits", "sum").alias("fingerprint"))
        schema = T.StructType([T.StructField("fingerprint", T.StringType())])
        path = f"{self.root}/batches"
        known = self._read(path, schema).where(F.col("batch_id") == batch_id).first()
        now = own.first()[0]
        if known and known["fingerprint"] != now:
            raise ValueError(f"batch {batch_id!r} has been run with another input")
        if not known:
            rows = self.spark.createDataFrame([(now,)], schema)
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return not self._marked("ended").where(F.col("batch_id") == batch_id).isEmpty()

    def _versions_path(self, generation: int) -> str:
        return f"{self.root}/versions/generation={generation}"

    def versions(self, before: str | None = None) -> DataFrame:
        """Version rows of batches that have ended; `before` leaves that batch out."""
        rows = self._of_ended(self._read(self._versions_path(self.generation()), VERSIONS))
        return rows if before is None else rows.where(F.col("batch_id") != before)

    def active(
        self, before: str | None = None, touching: DataFrame | None = None
    ) -> DataFrame:
        """Active versions; of the KEY3 groups that `touching` names only, if given.

        A batch needs the few groups it touches, and reads their buckets of the
        current state. `before` names the batch in progress, which hasn't ended.
        """
        if touching is None:
            return active_versions(self.versions(before))
        ended = self._marked("ended")
        if before is not None:
            ended = ended.where(F.col("batch_id") != before)
        return self.current.read(ended, touching)

    def find(self, report_ids: Sequence[str], version: int | None = None) -> DataFrame:
        """All versions of a few reports, or one version of each: a point lookup.

        The ids reach the scan, which skips row groups by their ranges and Bloom
        filters (`current.for_lookups`).
        """
        rows = self.versions().where(F.col("report_id").isin(list(report_ids)))
        return rows if version is None else rows.where(F.col("version") == version)

    def blobs(self, before: str | None = None) -> DataFrame:
        """Blobs not collected as garbage, those of batches that broke off included. A
        content stored again under a later batch is the same blob; readers go by id.
        `before`: what that batch can build on, the blobs of others that have ended."""
        rows = self._read(f"{self.root}/blobs", BLOBS)
        rows = rows.join(self._dead(), ["batch_id", "blob_id"], "left_anti")
        rows = rows.select(*BLOBS.fieldNames(), "batch_id")
        return rows if before is None else self._of_ended(rows).where(F.col("batch_id") != before)

    def _dead(self) -> DataFrame:
        return self._read(f"{self.root}/dead_blobs", T.StructType(BLOBS.fields[:1]))

    def append_blobs(self, rows: DataFrame, batch_id: str) -> None:
        path = f"{self.root}/blobs/batch_id={batch_id}"
        compressed(rows.write).mode("overwrite").parquet(path)
        if not self._dead().where(F.col("batch_id") == batch_id).isEmpty():
            none = self.spark.createDataFrame([], T.StructType(BLOBS.fields[:1]))
            none.write.mode("overwrite").parquet(f"{self.root}/dead_blobs/batch_id={batch_id}")

    def append_versions(self, rows: DataFrame, batch_id: str) -> None:
        path = f"{self._versions_path(self.generation())}/batch_id={batch_id}"
        for_lookups(rows).parquet(path)
        stored = self.spark.read.schema(VERSIONS).parquet(path)
        self.current.add(stored, batch_id)
        counts = blob_ops.references(stored).groupBy("blob_id").agg(F.count("*").alias("n"))
        path = f"{self.root}/refs/batch_id={batch_id}"
        counts.select(*_REFS.fieldNames()).write.mode("overwrite").parquet(path)

    def ledger(self) -> DataFrame:
        """blob_id and `refs`, the number of references from versions that stand.

        A sum of what batches added and purges took away, so that versions aren't
        read again; a blob that was never referred to has no row.
        """
        added = self._of_ended(self._read(f"{self.root}/refs", _REFS)).select("blob_id", "n")
        schema = T.StructType([*_REFS.fields, T.StructField("generation", T.IntegerType())])
        taken = self._read(f"{self.root}/unrefs", schema)
        taken = taken.where(F.col("generation") <= self.generation())
        both = added.union(taken.select("blob_id", -F.col("n")))
        return both.groupBy("blob_id").agg(F.sum("n").alias("refs"))

    def append_outcomes(self, rows: DataFrame, batch_id: str, kind: str) -> None:
        """Outcome rows of any kind, in the one layout that all of them share."""
        rows = rows.withColumn("kind", F.lit(kind))
        if "index" not in rows.columns:
            rows = rows.withColumn("index", F.col("seq"))
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in OUTCOMES
        ]
        path = f"{self.root}/outcomes/batch_id={batch_id}"
        compressed(rows.select(*columns).write).mode("overwrite").parquet(path)

    def outcomes(self, batch_id: str | None = None) -> DataFrame:
        rows = self._of_ended(self._read(f"{self.root}/outcomes", OUTCOMES))
        return rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)

    def audit(self) -> DataFrame:
        """Every audit entry ever made, whatever has been purged since."""
        return self._read(f"{self.root}/audit", AUDIT)

    def marked(self) -> DataFrame:
        """What a retention plan goes by: the identity, KEY3, age and `active` of each
        version. The rest of a version stays where it is."""
        return with_successor(self.versions().select(*retention.ROW_ID, *KEY3, "uploaded_at"))

    def clean(
        self,
        keep: int = retention.KEEP_VERSIONS,
        max_age_days: int | None = None,
        report_ids: DataFrame | None = None,
        scope: str = "triple",
        dry_run: bool = False,
    ) -> DataFrame:
        """Apply a retention rule: by age if `max_age_days` is given, otherwise by
        number, for all groups or those of the given reports. Blobs that no version
        refers to any more are collected."""
        marked = written(self.marked(), "marked")
        if max_age_days:
            plan = retention.purge_by_age(marked, utc_now(), max_age_days)
        else:
            plan = retention.purge_plan(marked, keep, scope, report_ids)
        done = self.purge(written(plan, "plan"), dry_run)
        if not dry_run:
            done = written(done, "purged")
            self.collect_blobs()
        return done

    def purge(self, plan: DataFrame, dry_run: bool = False) -> DataFrame:
        """Remove planned versions; returns purged and kept per group.

        Survivors go to a new generation, which counts from the moment its
        number is written. A dry run writes nothing.
        """
        if dry_run:
            return retention.purge_counts(self.versions(), plan)
        self.recover()
        current = self.generation()
        old = self.versions()
        target = self._versions_path(current + 1)
        for_lookups(retention.survivors(old, plan), "batch_id").parquet(target)
        stay = self._of_ended(self._read(target, VERSIONS))
        # What went is the difference of two counts, so no row is joined for it.
        refs = [(blob_ops.references(old), 1), (blob_ops.references(stay), -1)]
        both = [rows.select("blob_id", F.lit(n).cast("long").alias("n")) for rows, n in refs]
        taken = both[0].union(both[1]).groupBy("blob_id").agg(F.sum("n").alias("n")).where("n > 0")
        taken.select(*_REFS.fieldNames()).write.mode("overwrite").parquet(
            f"{self.root}/unrefs/generation={current + 1}"
        )
        pointer = self.spark.range(1).select(F.lit(current + 1).alias("generation"))
        pointer.write.mode("append").parquet(f"{self.root}/generations")
        self._fold()
        return retention.counts_between(old, stay)

    def collect_blobs(self) -> None:
        """Take blobs that nobody refers to out of the registry.

        Only their ids are written, in one job whatever the number of batches;
        contents stay where they are until `compact_blobs`. Should the job break
        off, run it again: what it had written is right by itself.
        """
        standing = self.ledger().where("refs > 0").select("blob_id")
        dead = self.blobs().select("blob_id", "batch_id").join(standing, "blob_id", "left_anti")
        dead = written(dead, "dead")
        dead.repartition("batch_id").write.mode("append").partitionBy("batch_id").parquet(
            f"{self.root}/dead_blobs"
        )

    def compact_blobs(self, target: Registry) -> None:
        """Write the blobs that count to the (fresh) registry folder `target`.

        Frees the space of dead contents: copy the other tables as files, switch
        readers over, and drop the old folder as a whole, so nothing is ever
        rewritten in place. Map-only but for the join on dead ids.
        """
        self.blobs().write.mode("errorifexists").partitionBy("batch_id").parquet(
            f"{target.root}/blobs"
        )
