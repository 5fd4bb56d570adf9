"""Drift of captured files, stale validations and handoff freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions import text as tx
from runledger.functions.attrs import attr_text, variant_field, variant_number
from runledger.ledger import Ledger
from runledger.lineage import cut
from runledger.operators.ownership import artifact_counts, artifact_experiments, zero
from runledger.operators.views import active_links
from runledger.schemas import ATTR_LOCAL_MTIME, ATTR_LOCAL_PATH, ATTR_LOCAL_SIZE


def normal_path(column):
    # plain test first: the pattern's end is a slash or a line end, and few paths have either
    return F.when(F.right(column, F.lit(1)).isin(*"/\n\r\x85\u2028\u2029"), F.regexp_replace(column, "(?<=.)/+$", "")).otherwise(column)


def observed_files(l: Ledger) -> DataFrame:
    return l.inventory.select(normal_path(F.col("path")).alias("path"), F.col("mtime").cast("double").alias("observed_mtime"),
                              F.col("size").cast("bigint").alias("observed_size"))


def drifted_artifacts(l: Ledger) -> DataFrame:
    """Active artifacts with capture attributes whose file is gone or differs."""
    # a text without either name needs no parser, any other is parsed once
    attrs = F.col("attrs_json")
    mtime_named, size_named = (F.contains(attrs, F.lit(f'"{key}"')) for key in (ATTR_LOCAL_MTIME, ATTR_LOCAL_SIZE))
    parsed = l.active("artifacts").filter(mtime_named | size_named).select(
        "id", "type", "uri", "updated_at", "attrs_json", F.json_object_keys(attrs).alias("_keys"), F.try_parse_json(attrs).alias("_attrs"))
    own = parsed.filter((mtime_named & F.array_contains("_keys", ATTR_LOCAL_MTIME)) | (size_named & F.array_contains("_keys", ATTR_LOCAL_SIZE)))
    captured = F.when(F.schema_of_variant(variant_field("_attrs", ATTR_LOCAL_PATH)) == "STRING", F.nullif(attr_text(attrs, ATTR_LOCAL_PATH), F.lit("")))
    arts = own.select(
        F.col("id").alias("artifact_id"), "type", "uri", "updated_at",
        variant_number(attrs, "_attrs", ATTR_LOCAL_MTIME).alias("captured_mtime"), variant_number(attrs, "_attrs", ATTR_LOCAL_SIZE).alias("captured_size"),
        normal_path(F.coalesce(captured, tx.local_path(F.col("uri")))).alias("path"))
    seen = arts.join(observed_files(l), "path", "left")
    mtime = ~F.col("captured_mtime").eqNullSafe(F.col("observed_mtime"))
    size = ~F.col("captured_size").eqNullSafe(F.col("observed_size").cast("double"))
    kind = (F.when(F.col("observed_mtime").isNull(), "missing_file").when(mtime & size, "mtime_size")
            .when(mtime, "mtime").when(size, "size"))
    return seen.withColumn("drift_kind", kind).filter(F.col("drift_kind").isNotNull()).select(
        "artifact_id", "type", "uri", "updated_at", "path", "captured_mtime", "captured_size", "observed_mtime",
        "observed_size", "drift_kind")


def drift(l: Ledger) -> DataFrame:
    """``drifted_artifacts``, stored once for all that read it."""
    return l.once("drift", lambda: cut(drifted_artifacts(l), "drift"))


def _validation_sources(l: Ledger) -> DataFrame:
    source = l.active("artifacts").select(F.col("id").alias("source_artifact_id"), F.col("updated_at").alias("source_updated_at"))
    return l.active("validations").select(
        F.col("id").alias("validation_id"), "entity_type", "entity_id", "check_name", "status", "updated_at", "source_artifact_id",
    ).join(source, "source_artifact_id")


_STALE_COLUMNS = ["validation_id", "entity_type", "entity_id", "check_name", "status", "updated_at", "source_artifact_id",
                  "source_updated_at", "source_drifted"]


def stale_validations(l: Ledger) -> DataFrame:
    """Active validations whose source artifact drifted or was updated afterwards."""
    drifted = drift(l).select(F.col("artifact_id").alias("source_artifact_id"), F.lit(1).alias("source_drifted"))
    return _validation_sources(l).join(drifted, "source_artifact_id", "left").withColumn(
        "source_drifted", F.coalesce("source_drifted", F.lit(0))).filter(
        (F.col("source_drifted") == 1) | (F.col("source_updated_at") > F.col("updated_at"))).select(_STALE_COLUMNS)


def drift_owners(l: Ledger) -> DataFrame:
    """(artifact_id, experiment_id) of drifted artifacts only; small against all artifacts, stored once."""
    return l.once("drift_owners", lambda: cut(artifact_experiments(l, only=cut(drift(l).select("artifact_id"), "drifted")), "drift-owners"))


def experiment_stale_validations(l: Ledger) -> DataFrame:
    """Same for validations directly on experiments; drift counts only for the experiment's own artifacts."""
    own = drift_owners(l).select(
        F.col("artifact_id").alias("source_artifact_id"), F.col("experiment_id").alias("entity_id"), F.lit(1).alias("source_drifted"))
    checks = _validation_sources(l).filter(F.col("entity_type") == "experiment")
    return checks.join(own, ["source_artifact_id", "entity_id"], "left").withColumn(
        "source_drifted", F.coalesce("source_drifted", F.lit(0))).filter(
        (F.col("source_drifted") == 1) | (F.col("source_updated_at") > F.col("updated_at"))).select(_STALE_COLUMNS)


def experiment_freshness(l: Ledger, stale_hours: float = 24.0) -> DataFrame:
    """Drift counts and handoff status of every experiment."""
    eid = F.col("entity_id").alias("experiment_id")
    drift = drift_owners(l).groupBy("experiment_id").agg(
        F.count("*").alias("drifted_artifact_count"))
    stale = experiment_stale_validations(l).groupBy(eid).agg(F.count("*").alias("stale_validation_count"))
    notes = l.active("notes").filter(F.col("entity_type") == "experiment").groupBy(eid).agg(
        F.max(F.when(F.col("note_type") == "checkpoint", F.col("created_at"))).alias("last_handoff_at"),
        F.sum(F.when(F.col("note_type") != "checkpoint", 1).otherwise(0)).alias("note_count"))
    checks = l.active("validations").filter(F.col("entity_type") == "experiment").groupBy(eid).agg(F.count("*").alias("validation_count"))
    jobs = l.active("jobs").filter(F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(F.count("*").alias("job_count"))
    runs = active_links(l).groupBy("experiment_id").agg(F.count("*").alias("run_count"))
    out = l.table("experiments").select(F.col("id").alias("experiment_id"), "name", "deleted_at")
    for part in (artifact_counts(l), drift, stale, notes, checks, jobs, runs):
        out = out.join(part, "experiment_id", "left")
    counts = ["artifact_count", "validation_count", "job_count", "run_count", "note_count"]
    activity = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0)).cast("bigint")
    hours = l.hours_since(F.col("last_handoff_at"))
    status = (F.when(F.col("last_handoff_at").isNull() & (activity == 0), "idle").when(F.col("last_handoff_at").isNull(), "missing")
              .when(hours > stale_hours, "stale").otherwise("current"))
    return out.select("experiment_id", "name", "deleted_at", zero("drifted_artifact_count"), zero("stale_validation_count"),
                      activity.alias("activity_count"), "last_handoff_at", hours.alias("since_last_handoff_hours"),
                      status.alias("handoff_status"))


def capture_metadata(l: Ledger) -> DataFrame:
    """Artifacts rows with capture attributes refreshed from the file inventory (rows with a file only)."""
    from runledger.functions.attrs import merge_objects

    arts = l.active("artifacts").withColumn("path", normal_path(tx.local_path(F.col("uri"))))
    fresh = F.to_json(F.create_map(
        F.lit(ATTR_LOCAL_MTIME), F.col("observed_mtime").cast("variant"),
        F.lit(ATTR_LOCAL_SIZE), F.col("observed_size").cast("variant"),
        F.lit(ATTR_LOCAL_PATH), F.col("path").cast("variant")))
    return arts.join(observed_files(l), "path").withColumn("attrs_json", merge_objects(F.col("attrs_json"), fresh)).withColumn(
        "updated_at", l.now).select(*l.table("artifacts").columns)
