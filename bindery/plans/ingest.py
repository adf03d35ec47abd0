"""Batch jobs that change the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bindery.functions.text import utc_now
from bindery.operators import batch, blobs
from bindery.operators.facts import content_facts, file_facts
from bindery.operators.mixed import BUNDLE, mixed, mixed_versions
from bindery.operators.ordered import SEGMENT_ROWS
from bindery.operators.patch import patch, patched_versions, resolve_keys
from bindery.operators.route import corrupt, create_only, lacking, route, version_rows
from bindery.operators.validate import manifest_outcomes, validate
from bindery.plans.registry import Registry
from bindery.schemas import FAILED, KEY3, UPDATED
from bindery.session import written
from bindery.sources import files, inline, manifests


def as_entries(bundles: DataFrame) -> DataFrame:
    """The field names that validation speaks of."""
    return bundles.withColumns(
        {
            "index": F.col("index" if "index" in bundles.columns else "seq"),
            "json_config": F.col("json_name"),
            "sql_file": F.col("sql_name"),
            "template": F.col("tpl_name"),
        }
    )


def _checked(bundles: DataFrame, profile: str, strict_json: bool) -> DataFrame:
    """Facts and findings of bundles with contents, written out for the steps
    that follow."""
    checked = validate(as_entries(content_facts(bundles, strict_json)), profile)
    if "undecodable" in bundles.columns:
        broken = F.concat(F.lit("Cannot decode "), F.col("undecodable"))
        checked = checked.withColumns(
            {
                "error": F.coalesce(F.when(F.col("undecodable").isNotNull(), broken), "error"),
                "valid": F.col("valid") & F.col("undecodable").isNull(),
            }
        )
    return _refuse_repeats(written(checked, "checked"))


# Fixed value: error of a row whose place in the order is not its own.
NO_PLACE = "seq is missing or given more than once"


def _refuse_repeats(checked: DataFrame) -> DataFrame:
    """Rows that share a `seq`, or have none, fail: the order decides versions, and
    contents are found by it."""
    counts = checked.groupBy("seq").agg(F.count("*").alias("n"))
    bad = written(counts.where("n > 1 OR seq IS NULL").select(F.col("seq").alias("_bad")), "bad")
    if bad.isEmpty():
        return checked
    marked = checked.join(bad, F.col("seq").eqNullSafe(F.col("_bad")), "left_semi")
    good = checked.join(bad, F.col("seq").eqNullSafe(F.col("_bad")), "left_anti")
    failed = marked.withColumns({"valid": F.lit(False), "error": F.lit(NO_PLACE)})
    return written(good.unionByName(failed), "checked")


def _refuse_corrupt(checked: DataFrame, active: DataFrame) -> DataFrame:
    """Bundles that would carry over a file the stored version lacks fail.

    `active` had better be stored: as a rule nothing in it lacks a file, and then
    the bundles aren't looked at.
    """
    if active.where(lacking()).isEmpty():
        return checked
    broken = written(corrupt(checked.where("valid"), active), "corrupt")
    if broken.isEmpty():
        return checked
    found = broken.select("seq", F.col("error").alias("_corrupt"))
    return written(
        checked.join(found, "seq", "left").withColumns(
            {
                "valid": F.col("valid") & F.col("_corrupt").isNull(),
                "error": F.coalesce("error", "_corrupt"),
            }
        ).drop("_corrupt"),
        "checked",
    )


def _store(
    registry: Registry,
    batch_id: str,
    plan: DataFrame,
    contents: DataFrame,
    on: Sequence[str],
    outcome: DataFrame,
    versions: DataFrame,
    kind: str,
) -> DataFrame:
    """Write a batch, its end last; returns the stored outcome."""
    registry.append_blobs(blobs.new_blobs(plan, contents, utc_now(), on), batch_id)
    registry.append_outcomes(outcome, batch_id, kind)
    registry.append_versions(versions, batch_id)
    registry.end(batch_id)
    return registry.outcomes(batch_id)


def ingest(
    registry: Registry,
    bundles: DataFrame,
    batch_id: str,
    profile: str = "inline",
    strict_json: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Validate, route and store one batch of bundles with contents.

    Contents are read twice: for the facts, and to store the new blobs. Returns
    the outcome rows as stored.
    """
    checked = _checked(bundles, profile, strict_json)
    known = checked.drop("seq") if "source" in checked.columns else checked
    if registry.begin(batch_id, known):
        return registry.outcomes(batch_id)
    active = written(registry.active(before=batch_id, touching=checked), "active")
    checked = _refuse_corrupt(checked, active)
    carry, identity = (), "seq"
    if "source" in checked.columns:  # known by its place, not by a number of ours
        carry = ("source", "index")
        identity = F.concat_ws("#", F.col("source"), F.col("index").cast("string"))
    valid = checked.where("valid")
    routed = route(valid, active, batch_id, segment_rows, carry, identity=identity)
    routed = written(routed, "routed")
    plan = blobs.upload_plan(blobs.uploads(routed), registry.blobs(before=batch_id))
    outcome = batch.details(checked, routed, inline=profile == "inline")
    contents = blobs.contents(bundles)
    return _store(
        registry, batch_id, plan, contents, blobs.UPLOAD, outcome, version_rows(routed), profile
    )


def ingest_requests(registry: Registry, requests: DataFrame, batch_id: str, **options) -> DataFrame:
    """Pushed bundles: decode, then as any batch. They count as uploaded now; the
    time a client gives has no say in retention."""
    bundles = inline.decode_bundles(requests).withColumn("uploaded_at", utc_now())
    return ingest(registry, bundles, batch_id, "inline", **options)


def ingest_manifests(
    registry: Registry,
    entries: DataFrame,
    on_disk: DataFrame,
    batch_id: str,
    strict_json: bool = False,
    segment_rows: int = SEGMENT_ROWS,
    manifests_read: DataFrame | None = None,
) -> DataFrame:
    """Validate, route and store the entries of manifests, whose files are on disk.

    With `manifests_read`, the manifests themselves, those that fail as a whole
    are part of the outcome.

    Each file is read once for its facts, however many entries name it; entries
    are joined with these, and a new content is read from one of its paths.
    """
    facts = written(file_facts(on_disk, strict_json), "file_facts")
    entries = written(entries, "entries")
    checked = validate(files.attach(entries, facts), "manifest")
    checked = written(manifests.numbered(checked), "checked")
    if registry.begin(batch_id, checked.drop("seq")):
        return registry.outcomes(batch_id)
    bundles = files.as_bundles(checked.where("valid"), F.col("seq"), utc_now(), ("source", "index"))
    active = registry.active(before=batch_id, touching=bundles)
    carry = ("source", "index")
    # Ids come from the place in the manifest: `seq` depends on the partitions.
    place = F.concat_ws("#", F.col("source"), F.col("index").cast("string"))
    routed = route(bundles, active, batch_id, segment_rows, carry, identity=place)
    routed = written(routed, "routed")
    plan = blobs.upload_plan(blobs.uploads(routed), registry.blobs(before=batch_id))
    by_path = blobs.plan_by_path(plan, facts)
    outcome = batch.details(checked, routed)
    if manifests_read is not None:
        failed = manifest_outcomes(manifests_read)
        outcome = outcome.unionByName(failed, allowMissingColumns=True)
    contents = on_disk.select("path", "content")
    return _store(
        registry, batch_id, by_path, contents, ("path",), outcome, version_rows(routed), "manifest"
    )


def create_records(
    registry: Registry, bundles: DataFrame, batch_id: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Store bundles whose key is free; the others fail as duplicates."""
    checked = _checked(bundles, "create", False)
    if registry.begin(batch_id, checked):
        return registry.outcomes(batch_id)
    active = registry.active(before=batch_id, touching=checked)
    tried = written(create_only(checked.where("valid"), active, batch_id, segment_rows), "tried")
    refused = tried.where(F.col("status") == FAILED).select("seq", F.col("error").alias("_refused"))
    judged = written(
        checked.join(refused, "seq", "left").withColumns(
            {
                "valid": F.col("valid") & F.col("_refused").isNull(),
                "error": F.coalesce("error", "_refused"),
            }
        ),
        "judged",
    )
    routed = written(route(judged.where("valid"), None, batch_id, segment_rows), "routed")
    plan = blobs.upload_plan(blobs.uploads(routed), registry.blobs(before=batch_id))
    outcome = batch.details(judged, routed, inline=True)
    contents = blobs.contents(bundles)
    return _store(
        registry, batch_id, plan, contents, blobs.UPLOAD, outcome, version_rows(routed), "create"
    )


def apply_patches(
    registry: Registry,
    patches: DataFrame,
    batch_id: str,
    by_key: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Apply one batch of decoded patches with contents; returns the outcome.

    A patch names its record by `report_id`, or with `by_key` by the three key
    columns and the name of the config it brings.
    """
    entry = as_entries(content_facts(patches))
    known = F.col("error") if "error" in patches.columns else F.lit(None).cast("string")
    checked = validate(entry.withColumn("_known", known), "patch").withColumn(
        "error", F.coalesce("_known", F.when(F.col("json_sum").isNotNull(), F.col("error")))
    )
    checked = written(checked, "patches")
    if registry.begin(batch_id, checked):
        return registry.outcomes(batch_id)
    if by_key:
        active = written(registry.active(before=batch_id, touching=checked), "active")
        checked = written(resolve_keys(checked, active), "resolved")
    else:
        # A patch may move a record to a key that another report of its KEY3 holds.
        named = registry.versions(before=batch_id).join(
            checked.select("report_id").distinct(), "report_id", "left_semi"
        )
        active = written(registry.active(before=batch_id, touching=named), "active")
    outcome = written(patch(checked, active, segment_rows), "patched")
    done = outcome.where(F.col("status") == UPDATED).select("seq")
    brought = blobs.brought(checked.join(done, "seq", "left_semi"))
    plan = blobs.upload_plan(brought, registry.blobs(before=batch_id))
    contents = blobs.contents(patches)
    return _store(
        registry, batch_id, plan, contents, blobs.UPLOAD, outcome, patched_versions(outcome), "patch"
    )


def apply_mixed(
    registry: Registry, rows: DataFrame, batch_id: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Apply one batch of bundles and patches, taken one after another by `seq`.

    `rows` has contents and a `kind` as for `mixed`; bundles are checked as pushed
    ones, patches as patches. Returns the outcome as stored.
    """
    entry = written(as_entries(content_facts(rows)), "mixed-facts")
    is_bundle = F.col("kind") == BUNDLE
    pushed = validate(entry.where(is_bundle), "inline")
    patched = validate(entry.where(~is_bundle), "patch").withColumn(
        "error", F.when(F.col("json_sum").isNotNull(), F.col("error"))
    )
    checked = written(pushed.unionByName(patched), "checked")
    if registry.begin(batch_id, checked):
        return registry.outcomes(batch_id)
    named = registry.versions(before=batch_id).join(
        checked.select("report_id").distinct(), "report_id", "left_semi"
    )
    groups = checked.where(F.col("csi_id").isNotNull()).select(*KEY3).union(named.select(*KEY3))
    active = written(registry.active(before=batch_id, touching=groups), "active")
    outcome = written(mixed(checked, active, batch_id, segment_rows), "outcome")
    done = outcome.where("is_new_version").select("seq")
    plan = blobs.upload_plan(
        blobs.brought(checked.join(done, "seq", "left_semi")), registry.blobs(before=batch_id)
    )
    return _store(
        registry, batch_id, plan, blobs.contents(rows), blobs.UPLOAD, outcome,
        mixed_versions(outcome), "mixed",
    )
