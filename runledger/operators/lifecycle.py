"""Flagship query: lifecycle, review and handoff state of every experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.attrs import attr_text
from runledger.ledger import Ledger
from runledger.operators.ownership import count_if, flag, zero
from runledger.operators.views import active_links, failed_job_states
from runledger.schemas import ACTIVE_JOB_STATUSES, ATTR_REVIEWED_COUNT, TERMINAL_JOB_STATUSES, UNCERTAIN_JOB_STATUSES

_JOB_COUNTS = ["job_count", "failed_job_count", "blocking_failed_job_count", "recovery_in_progress_failed_job_count",
               "recovered_failed_job_count", "active_job_count", "submission_uncertainty_count", "stale_submission_count"]
_OTHER_COUNTS = ["run_count", "validation_count", "failing_validation_count", "active_lease_count", "stale_lease_count",
                 "artifact_count", "non_handoff_note_count"]


def _job_parts(l: Ledger) -> DataFrame:
    """Jobs combined per (own experiment, run): counts plus the reviewable-activity
    count and latest key.  Recovered failures are activity twice, on purpose."""
    j = failed_job_states(l)
    ended = F.col("status").isin(TERMINAL_JOB_STATUSES)
    again = F.col("is_recovered_failed") == 1
    end_key = F.when(ended, F.struct(F.coalesce("finished_at", "updated_at").alias("at"), F.col("job_id").alias("id")))
    again_key = F.when(again, F.struct(F.col("updated_at").alias("at"), F.col("job_id").alias("id")))
    return j.groupBy(F.col("experiment_id").alias("direct_id"), "run_id").agg(
        F.count("*").alias("job_count"),
        count_if(F.col("status") == "failed").alias("failed_job_count"),
        count_if(F.col("is_blocking_failed") == 1).alias("blocking_failed_job_count"),
        count_if(F.col("is_recovery_in_progress") == 1).alias("recovery_in_progress_failed_job_count"),
        count_if(again).alias("recovered_failed_job_count"),
        count_if(F.col("status").isin(ACTIVE_JOB_STATUSES)).alias("active_job_count"),
        count_if(F.col("status").isin(UNCERTAIN_JOB_STATUSES)).alias("submission_uncertainty_count"),
        count_if(F.col("status").isin(UNCERTAIN_JOB_STATUSES) & (F.col("updated_at") < l.ago(1))).alias("stale_submission_count"),
        (count_if(ended) + count_if(again)).alias("activity"),
        F.greatest(F.max(end_key), F.max(again_key)).alias("key"))


def _job_counts(l: Ledger) -> DataFrame:
    """A job counts for its own experiment and for those linked to its run, once each."""
    parts = _job_parts(l)
    cols = [*_JOB_COUNTS, "activity", "key"]
    links = l.table("experiment_runs").select("experiment_id", "run_id")
    direct = parts.filter(F.col("direct_id").isNotNull()).select(F.col("direct_id").alias("experiment_id"), *cols)
    linked = parts.join(links, "run_id").filter(~F.col("direct_id").eqNullSafe(F.col("experiment_id"))).select("experiment_id", *cols)
    return direct.unionByName(linked).groupBy("experiment_id").agg(
        *[F.sum(c).alias(c) for c in [*_JOB_COUNTS, "activity"]], F.max("key").alias("key"))


def _key(at: str = "updated_at"):
    return F.struct(F.col(at).alias("at"), F.col("id").alias("id"))


def lifecycle(l: Ledger) -> DataFrame:
    """One row per experiment, archived ones included (also the dashboard view)."""
    eid = F.col("entity_id").alias("experiment_id")
    runs = active_links(l).groupBy("experiment_id").agg(F.count("*").alias("run_count"))
    jobs = _job_counts(l).withColumnRenamed("activity", "job_activity").withColumnRenamed("key", "job_key")
    checks = l.active("validations").filter(F.col("entity_type") == "experiment").groupBy(eid).agg(
        F.count("*").alias("validation_count"), count_if(F.col("status") == "fail").alias("failing_validation_count"),
        F.max(_key()).alias("check_key"))
    arts = l.active("artifacts").filter(F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(
        F.count("*").alias("artifact_count"), F.max(_key()).alias("artifact_key"))
    held = F.col("released_at").isNull()
    leases = l.table("leases").filter((F.col("entity_type") == "experiment") & held).groupBy(eid).agg(
        F.count("*").alias("active_lease_count"), count_if(F.col("heartbeat_at") < l.ago(1)).alias("stale_lease_count"))
    kind = F.col("note_type")
    worked = kind.isin("next-action", "debug", "research", "decision") & (F.col("status") != "superseded")
    review = F.when(kind == "review", F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"),
                                               attr_text(F.col("attrs_json"), ATTR_REVIEWED_COUNT).alias("n")))
    notes = l.active("notes").filter(F.col("entity_type") == "experiment").groupBy(eid).agg(
        count_if(~kind.isin("checkpoint", "review")).alias("non_handoff_note_count"),
        F.max(F.when(kind == "checkpoint", F.col("created_at"))).alias("last_handoff_at"),
        F.max(review).alias("review"),
        count_if(worked).alias("note_activity"), F.max(F.when(worked, _key())).alias("note_key"))

    out = l.table("experiments").select(F.col("id").alias("experiment_id"), "name", "status", "created_at", "updated_at", "deleted_at")
    for part in (runs, jobs, checks, arts, leases, notes):
        out = out.join(part, "experiment_id", "left")
    zeroed = [zero(c) for c in [*_JOB_COUNTS, *_OTHER_COUNTS]]
    nz = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    out = out.select(
        "experiment_id", "name", "status", "created_at", "updated_at", "deleted_at", *zeroed, "last_handoff_at",
        F.col("review.at").alias("last_reviewed_at"),
        F.struct("review.at", "review.id").alias("review_key"),
        F.expr("try_cast(review.n AS BIGINT)").alias("reviewed_activity_count"),
        (nz("job_activity") + nz("validation_count") + nz("artifact_count") + nz("note_activity")).alias("reviewable_activity_count"),
        F.greatest("job_key", "check_key", "artifact_key", "note_key").alias("activity_key"))
    pending = F.col("activity_key").isNotNull() & (
        F.col("last_reviewed_at").isNull()
        | (F.col("activity_key") > F.col("review_key"))
        | (F.col("reviewable_activity_count") > F.coalesce("reviewed_activity_count", F.lit(-1))))
    busy = F.col("run_count") + F.col("job_count") + F.col("validation_count") + F.col("artifact_count") + F.col("non_handoff_note_count")
    out = out.withColumn("has_pending_review", flag(pending)).withColumn(
        "handoff_status",
        F.when(F.col("last_handoff_at").isNull() & (busy == 0), "idle").when(F.col("last_handoff_at").isNull(), "missing")
        .when(F.col("last_handoff_at") < l.ago(24), "stale").otherwise("current"))
    state = (
        F.when(F.col("deleted_at").isNotNull() | (F.col("status") == "archived"), "archived")
        .when((F.col("blocking_failed_job_count") > 0) | (F.col("failing_validation_count") > 0)
              | (F.col("stale_lease_count") > 0) | (F.col("stale_submission_count") > 0), "needs_attention")
        .when(F.col("active_job_count") > 0, "running").when(F.col("has_pending_review") == 1, "review").otherwise("open"))
    return out.select(
        "experiment_id", "name", "status", "created_at", "updated_at", "deleted_at", *[c for c in ["run_count", *_JOB_COUNTS]],
        "validation_count", "failing_validation_count", "active_lease_count", "stale_lease_count", "artifact_count",
        "non_handoff_note_count", "last_handoff_at", F.col("last_handoff_at").alias("last_checkpoint_at"), "last_reviewed_at",
        "reviewed_activity_count", "reviewable_activity_count",
        F.col("activity_key.at").alias("last_reviewable_activity_at"), F.col("activity_key.id").alias("last_reviewable_activity_id"),
        "has_pending_review", "handoff_status", state.alias("lifecycle_state"))


GROUP_LABELS = {"needs_attention": "Needs attention", "running": "Running", "review": "Review", "open": "Open",
                "archived": "Archived"}


def experiment_groups(l: Ledger) -> DataFrame:
    """Display group and size per lifecycle state that occurs."""
    label = F.col("lifecycle_state")
    for state, text in GROUP_LABELS.items():
        label = F.when(F.col("lifecycle_state") == state, F.lit(text)).otherwise(label)
    return lifecycle(l).groupBy("lifecycle_state").agg(F.count("*").alias("experiment_count")).select(
        label.alias("display_group"), "lifecycle_state", "experiment_count")
