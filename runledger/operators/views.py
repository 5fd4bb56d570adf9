"""Stable views of the ledger, each over all experiments at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from runledger.functions import text as tx
from runledger.ledger import Ledger
from runledger.operators import graph
from runledger.operators.ownership import artifact_counts, artifact_experiments, count_if, flag, zero
from runledger.schemas import ATTR_REQUIRED_METRICS, UNCERTAIN_JOB_STATUSES

ATTENTION_STATUSES = ["submitting", "unknown_submit", "queued", "running", "failed"]
TRACKER = "wandb"


# --- plain projections -------------------------------------------------------

def artifacts(l: Ledger) -> DataFrame:
    return l.active("artifacts").select(
        F.col("id").alias("artifact_id"), "experiment_id", "run_id", "job_id", "type", "uri", "content_hash",
        "created_at", "updated_at", "attrs_json")


def notes(l: Ledger) -> DataFrame:
    return l.active("notes").select(
        F.col("id").alias("note_id"), "entity_type", "entity_id", "note_type", "status", "title", "body_format", "body",
        "author", "created_at", "updated_at", "attrs_json")


def sync_events(l: Ledger) -> DataFrame:
    return l.table("sync_events").select(
        F.col("id").alias("sync_event_id"), "target_system", "target_identifier", "status", "origin", "run_id", "job_id",
        "source_entity_type", "source_entity_id", "target_field", "error_message", "reconcile_event_id",
        "idempotency_key", "payload_summary_json", "created_at", "attrs_json")


def jobs(l: Ledger) -> DataFrame:
    return l.active("jobs").select(
        "id", F.col("id").alias("job_id"), "experiment_id", "run_id", "name", "status", "command", "launcher",
        "external_system", "external_id", "retry_of", "failure_reason", "code_commit", "code_dirty", "created_at",
        "updated_at", "started_at", "finished_at", "attrs_json")


def validations(l: Ledger) -> DataFrame:
    return l.active("validations").select(
        F.col("id").alias("validation_id"), "entity_type", "entity_id", "check_name", "status", "expected_value",
        "measured_value", "details_json", "source_artifact_id", "source_job_id", "session_id", "created_at",
        "updated_at", "attrs_json")


def sessions(l: Ledger) -> DataFrame:
    return l.table("sessions").withColumnRenamed("id", "session_id")


def experiment_session_history(l: Ledger) -> DataFrame:
    return (l.table("sessions").filter(F.col("experiment_id").isNotNull())
            .orderBy(F.desc("started_at"), F.desc("id"))
            .select("experiment_id", F.col("id").alias("session_id"), "ledger_id", "agent", "cwd", "git_branch",
                    "git_commit", "intent", "started_at", "last_touch_at", "ended_at", "attrs_json"))


def refresh_log(l: Ledger) -> DataFrame:
    return l.table("refresh_events").withColumnRenamed("id", "refresh_event_id")


def lease_history(l: Ledger) -> DataFrame:
    return l.table("leases").withColumnRenamed("id", "lease_id")


def dashboard_validations(l: Ledger) -> DataFrame:
    return validations(l).filter(F.col("entity_type") == "experiment").select(
        F.col("entity_id").alias("experiment_id"), "validation_id", "check_name", "status", "expected_value",
        "measured_value", "updated_at")


def dashboard_notes(l: Ledger) -> DataFrame:
    return l.active("notes").filter(F.col("entity_type") == "experiment").select(
        F.col("entity_id").alias("experiment_id"), F.col("id").alias("note_id"), "note_type", "status", "title",
        F.substring("body", 1, 240).alias("body_preview"), "updated_at")


def dashboard_artifacts(l: Ledger) -> DataFrame:
    none = F.lit(None).cast("string")
    return l.active("artifacts").filter(F.col("experiment_id").isNotNull()).select(
        "experiment_id", F.col("id").alias("artifact_id"), F.col("type").alias("artifact_type"), "uri",
        none.alias("external_system"), none.alias("external_id"), "updated_at")


# --- lists per entity --------------------------------------------------------

def experiments(l: Ledger) -> DataFrame:
    tags = l.table("experiment_tags").groupBy("experiment_id").agg(
        F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    exp = l.active("experiments").withColumnRenamed("id", "experiment_id")
    return exp.join(tags, "experiment_id", "left").select(
        "experiment_id", "name", "description", "status", "idempotency_key", "created_at", "updated_at", "attrs_json",
        F.coalesce("tags", F.lit("")).alias("tags"))


def runs(l: Ledger) -> DataFrame:
    live = l.active("experiments").select(F.col("id").alias("experiment_id"))
    linked = l.table("experiment_runs").join(live, "experiment_id").groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list("experiment_id")), ",").alias("experiment_ids"))
    return l.active("runs").withColumn("run_id", F.col("id")).join(linked, "run_id", "left").select(
        "id", "run_id", "experiment_id", "name", "description", "status", "kind", "idempotency_key", "external_system",
        "external_id", "parent_run_id", "created_at", "updated_at", "attrs_json",
        F.coalesce("experiment_ids", F.lit("")).alias("experiment_ids"))


def job_runs(l: Ledger) -> DataFrame:
    live_jobs = l.active("jobs").select(F.col("id").alias("job_id"))
    live_runs = l.active("runs").select(F.col("id").alias("run_id"), "experiment_id")
    return l.active("job_runs").join(live_jobs, "job_id", "left_semi").join(live_runs, "run_id").select(
        "job_id", "run_id", "experiment_id", "role", "status", "started_at", "finished_at", "failure_reason",
        "created_at", "updated_at", "attrs_json")


# --- metrics -----------------------------------------------------------------

def active_links(l: Ledger) -> DataFrame:
    """(experiment_id, run_id) links to active runs."""
    live = l.active("runs").select(F.col("id").alias("run_id"))
    return l.table("experiment_runs").select("experiment_id", "run_id").join(live, "run_id", "left_semi")


def metrics_long(l: Ledger) -> DataFrame:
    live = l.active("runs").select(F.col("id").alias("run_id"), F.col("name").alias("run_name"))
    links = l.table("experiment_runs").select("experiment_id", "run_id").join(live, "run_id")
    return l.active("metrics").join(links, "run_id").select(
        "experiment_id", "run_id", "run_name", F.col("id").alias("metric_id"), "metric_name", "value", "step", "split",
        "source_job_id", "source_artifact_id", "updated_at")


def metric_coverage(l: Ledger) -> DataFrame:
    links = active_links(l)
    totals = links.groupBy("experiment_id").agg(F.count("*").alias("total_runs"))
    # One row per (run, metric) before the fan-out to experiments, so plain counts are distinct counts.
    per_run = l.active("metrics").groupBy("run_id", "metric_name").agg(F.lit(1).alias("seen")).drop("seen")
    counts = per_run.join(links, "run_id").groupBy("experiment_id", "metric_name").agg(F.count("*").alias("run_count"))
    return counts.join(totals, "experiment_id").select(
        "experiment_id", "metric_name", "run_count", "total_runs",
        (F.col("run_count").cast("double") / F.col("total_runs")).alias("coverage"))


# --- counts ------------------------------------------------------------------

def experiment_summary(l: Ledger) -> DataFrame:
    """The reference shape joins jobs and artifacts on OR conditions; here every entity is
    pre-aggregated on its owner keys and only those partial counts follow the links."""
    links = l.table("experiment_runs").select("experiment_id", "run_id").join(
        l.table("runs").select(F.col("id").alias("run_id"), F.col("deleted_at").isNull().alias("run_live")), "run_id")
    run_counts = links.groupBy("experiment_id").agg(count_if(F.col("run_live")).alias("run_count"))

    job_parts = l.active("jobs").groupBy(F.col("experiment_id").alias("direct_id"), "run_id").agg(
        F.count("*").alias("n"), count_if(F.col("status") == "failed").alias("nf"),
        count_if(F.col("status") == "running").alias("nr"))
    via_run = job_parts.join(links.select("experiment_id", "run_id"), "run_id").filter(
        ~F.col("direct_id").eqNullSafe(F.col("experiment_id")))
    job_counts = (job_parts.filter(F.col("direct_id").isNotNull()).select(F.col("direct_id").alias("experiment_id"), "n", "nf", "nr")
                  .unionByName(via_run.select("experiment_id", "n", "nf", "nr"))
                  .groupBy("experiment_id").agg(F.sum("n").alias("job_count"), F.sum("nf").alias("failed_job_count"),
                                                F.sum("nr").alias("running_job_count")))

    art_counts = artifact_counts(l)

    metric_counts = l.active("metrics").groupBy("run_id").agg(F.count("*").alias("n")).join(links, "run_id").groupBy(
        "experiment_id").agg(F.sum("n").alias("metric_count"))
    note_counts = l.active("notes").filter((F.col("entity_type") == "experiment") & (F.col("status") == "open")).groupBy(
        F.col("entity_id").alias("experiment_id")).agg(F.count("*").alias("open_note_count"))

    out = l.active("experiments").withColumnRenamed("id", "experiment_id").select("experiment_id", "name", "status", "updated_at")
    for part in (run_counts, job_counts, art_counts, metric_counts, note_counts):
        out = out.join(part, "experiment_id", "left")
    return out.select("experiment_id", "name", "status", "updated_at", *[zero(c) for c in (
        "run_count", "job_count", "failed_job_count", "running_job_count", "artifact_count", "metric_count", "open_note_count")])


def run_summary(l: Ledger) -> DataFrame:
    linked = l.table("experiment_runs").groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("experiment_id")), ",").alias("experiment_ids"))
    live_jobs = l.active("jobs").select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    job_counts = l.active("job_runs").select("job_id", "run_id").join(live_jobs, "job_id").groupBy("run_id").agg(
        F.count("*").alias("job_count"), count_if(F.col("job_status") == "failed").alias("failed_job_count"))
    art_counts = l.active("artifacts").filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.count("*").alias("artifact_count"))
    metric_counts = l.active("metrics").groupBy("run_id").agg(F.count("*").alias("metric_count"))
    out = l.active("runs").withColumnRenamed("id", "run_id").select(
        "run_id", "experiment_id", "name", "status", "kind", "idempotency_key", "parent_run_id", "updated_at")
    for part in (linked, job_counts, art_counts, metric_counts):
        out = out.join(part, "run_id", "left")
    return out.select("run_id", "experiment_id", "name", "status", "kind", "idempotency_key", "parent_run_id", "updated_at",
                      F.coalesce("experiment_ids", F.lit("")).alias("experiment_ids"),
                      *[zero(c) for c in ("job_count", "failed_job_count", "artifact_count", "metric_count")])


def jobs_needing_attention(l: Ledger) -> DataFrame:
    return l.active("jobs").filter(F.col("status").isin(ATTENTION_STATUSES)).select(
        F.col("id").alias("job_id"), "experiment_id", "run_id", "name", "status", "launcher", "external_system",
        "external_id", "retry_of", "failure_reason", "updated_at", "started_at", "finished_at")


def artifact_latest_per_type(l: Ledger) -> DataFrame:
    keys = [F.coalesce(c, F.lit("")) for c in ("experiment_id", "run_id", "job_id")]
    w = W.partitionBy(*keys, "type").orderBy(F.desc("updated_at"), F.desc("id"))
    return l.active("artifacts").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        F.col("id").alias("artifact_id"), "experiment_id", "run_id", "job_id", "type", "uri", "content_hash", "updated_at")


def tracker_sync_coverage(l: Ledger) -> DataFrame:
    """Events reach a run by id or by its external id: two equi-joins, the second one
    skipping pairs the first already has, then one combining aggregate per run."""
    live = l.active("runs")
    sync = l.table("sync_events").filter((F.col("target_system") == TRACKER) & (F.col("origin") == "manifest")).select(
        F.col("id").alias("sync_id"), F.col("run_id").alias("sync_run_id"), "target_identifier", F.col("status").alias("sync_status"),
        F.col("created_at").alias("sync_at"))
    # one row per (named run, target) first, so a target that many events share meets its runs once
    newest = sync.groupBy("sync_run_id", "target_identifier").agg(F.max(F.struct("sync_at", "sync_id", "sync_status")).alias("latest"), F.count("*").alias("n"))
    part = [F.col("id").alias("run_id"), "latest", "n"]
    by_id = newest.join(live.select("id"), F.col("sync_run_id") == F.col("id")).select(*part)
    by_ext = newest.join(live.select("id", "external_id"), F.col("target_identifier") == F.col("external_id")).filter(
        ~F.col("sync_run_id").eqNullSafe(F.col("id"))).select(*part)
    best = by_id.unionByName(by_ext).groupBy("run_id").agg(F.max("latest").alias("latest"), F.sum("n").alias("n"))
    return live.withColumnRenamed("id", "run_id").join(best, "run_id", "left").select(
        "run_id", F.col("name").alias("run_name"), "external_system", "external_id",
        flag((F.col("external_system") == TRACKER) & F.col("external_id").isNotNull()).alias("has_tracker_external_id"),
        F.col("latest.sync_status").alias("latest_sync_status"), F.col("latest.sync_at").alias("latest_sync_at"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("sync_count"))


def tracker_writeback_coverage(l: Ledger) -> DataFrame:
    events = l.table("sync_events").filter(
        (F.col("target_system") == TRACKER) & (F.col("origin") == "writeback") & (F.col("source_entity_type") == "metric")
        & F.col("source_entity_id").isNotNull() & F.col("target_field").isNotNull())
    return events.groupBy("source_entity_id", "target_identifier", "target_field").agg(
        F.max(F.struct("created_at", "id", "run_id", "status", "error_message")).alias("last"),
        F.count("*").alias("attempt_count"),
    ).select(F.col("last.run_id").alias("source_run_id"), "source_entity_id", "target_identifier", "target_field",
             F.col("last.status").alias("latest_status"), F.col("last.error_message").alias("latest_error_message"),
             F.col("last.created_at").alias("latest_event_at"), "attempt_count")


def reconcile_log(l: Ledger) -> DataFrame:
    ops = l.table("reconcile_operations").groupBy("reconcile_event_id").agg(F.count("*").alias("operation_count"))
    return l.table("reconcile_events").withColumnRenamed("id", "reconcile_event_id").join(ops, "reconcile_event_id", "left").select(
        "reconcile_event_id", "experiment_id", "session_id", "source", "created_at", "counts_json", "inserts_json",
        "updates_json", zero("operation_count"))


def artifacts_redacted(l: Ledger) -> DataFrame:
    owner = artifact_experiments(l).groupBy("artifact_id").agg(F.min("experiment_id").alias("owner_id"))
    return l.active("artifacts").withColumnRenamed("id", "artifact_id").join(owner, "artifact_id", "left").select(
        "artifact_id", F.col("owner_id").alias("experiment_id"), "run_id", "job_id", "type",
        tx.uri_locality(F.col("uri")).alias("uri_locality"),
        tx.display_uri(F.col("artifact_id"), F.col("uri")).alias("display_uri"),
        "content_hash", "created_at", "updated_at", "attrs_json")


# --- retry recovery ----------------------------------------------------------

def failed_job_states(l: Ledger) -> DataFrame:
    """Active jobs with what became of the failed ones, as in ``jobs_with_recovery``; only failed jobs are sent to the retry summary."""
    summary = graph.retry_recovery(l).select(F.col("root_id").alias("job_id"), "has_success_descendant", "has_active_descendant")
    jobs = l.active("jobs").select(F.col("id").alias("job_id"), "experiment_id", "run_id", "status", "updated_at", "finished_at")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    won, busy = F.coalesce("has_success_descendant", F.lit(0)), F.coalesce("has_active_descendant", F.lit(0))
    ended = jobs.filter(failed).join(summary, "job_id", "left").select(
        *jobs.columns, flag((won == 0) & (busy == 0)).alias("is_blocking_failed"), flag((won == 0) & (busy == 1)).alias("is_recovery_in_progress"),
        flag(won == 1).alias("is_recovered_failed"))
    return ended.unionByName(jobs.filter(~failed).select(*jobs.columns, *[F.lit(0).alias(c) for c in ended.columns[len(jobs.columns):]]))


def jobs_with_recovery(l: Ledger) -> DataFrame:
    summary = graph.retry_recovery(l).withColumnRenamed("root_id", "job_id")
    joined = l.active("jobs").withColumnRenamed("id", "job_id").join(summary, "job_id", "left")
    won = F.coalesce("has_success_descendant", F.lit(0))
    busy = F.coalesce("has_active_descendant", F.lit(0))
    failed = F.col("status") == "failed"
    return joined.select(
        "job_id", "experiment_id", "run_id", "name", "status", "command", "launcher", "retry_of", "external_system",
        "external_id", "failure_reason", "code_commit", "code_dirty", "created_at", "updated_at", "started_at",
        "finished_at", "deleted_at", "attrs_json",
        won.alias("has_success_descendant"), busy.alias("has_active_descendant"),
        "success_descendant_id", "active_descendant_id",
        F.when(failed & (won == 1), "recovered_failed").when(failed & (busy == 1), "recovery_in_progress")
        .when(failed, "blocking_failed").alias("retry_state"),
        flag(failed & (won == 0) & (busy == 0)).alias("is_blocking_failed"),
        flag(failed & (won == 0) & (busy == 1)).alias("is_recovery_in_progress"),
        flag(failed & (won == 1)).alias("is_recovered_failed"),
        flag(F.col("status").isin(UNCERTAIN_JOB_STATUSES)).alias("is_submission_uncertain"))


BLOCKING_TEXT = '"validation.blocking":true'


def experiment_blockers(l: Ledger) -> DataFrame:
    rec = jobs_with_recovery(l)

    def job_rows(condition, blocker):
        return rec.filter(condition).select(
            F.col("job_id").alias("entity_id"), "experiment_id", F.lit("job").alias("entity_type"),
            blocker.alias("blocker_type"), "status", "updated_at", F.col("failure_reason").alias("message"))

    failed = job_rows(F.col("is_blocking_failed") == 1, F.lit("blocking_failed_job"))
    uncertain = job_rows(F.col("status").isin(UNCERTAIN_JOB_STATUSES),
                         F.when(F.col("status") == "submitting", "submission_in_progress").otherwise("submission_unknown"))
    bad = l.active("validations").filter(
        (F.col("entity_type") == "experiment")
        & ((F.col("status") == "fail") | ((F.col("status") == "unknown") & F.contains("attrs_json", F.lit(BLOCKING_TEXT)))))
    checks = bad.select(
        F.col("id").alias("entity_id"), F.col("entity_id").alias("experiment_id"), F.lit("validation").alias("entity_type"),
        F.when(F.col("status") == "fail", "validation_failed").otherwise("validation_unknown_blocking").alias("blocker_type"),
        "status", "updated_at", F.col("check_name").alias("message"))
    return failed.unionByName(uncertain).unionByName(checks)


# --- run progress ------------------------------------------------------------

def runs_progress(l: Ledger) -> DataFrame:
    live_jobs = l.active("jobs").select(F.col("id").alias("job_id"))
    edge = l.active("job_runs").select("job_id", "run_id", "role", "status").join(live_jobs, "job_id", "left_semi")
    train, evals = F.col("role") == "train", F.col("role") == "eval"
    lost = F.col("status").isin("failed", "killed")
    won = F.col("status") == "succeeded"
    by_edge = edge.groupBy("run_id").agg(
        F.count("*").alias("job_edge_count"),
        count_if(train & F.col("status").isin("submitting", "queued", "running")).alias("train_active_count"),
        count_if(train & won).alias("train_succeeded_count"),
        count_if(evals & won).alias("eval_succeeded_count"),
        count_if(lost).alias("failed_count"),
        count_if(train & lost).alias("train_failed"), count_if(evals & lost).alias("eval_failed"),
        count_if(~train & ~evals & lost).alias("other_failed"),
        count_if(F.col("status") == "skipped").alias("skipped_count"))
    by_artifact = l.active("artifacts").filter(F.col("run_id").isNotNull() & F.col("type").isin("checkpoint", "eval-result")).groupBy("run_id").agg(
        F.max(flag(F.col("type") == "checkpoint")).alias("has_checkpoint"),
        F.max(flag(F.col("type") == "eval-result")).alias("has_eval_result"))
    # Two levels of grouping instead of countDistinct: the first one combines map-side per (run, name).
    by_metric = l.active("metrics").groupBy("run_id", "metric_name").agg(F.lit(1).alias("one")).groupBy("run_id").agg(
        F.count("*").alias("metric_count"))
    required = l.table("experiments").select(
        F.col("id").alias("experiment_id"),
        F.coalesce(F.json_array_length(F.get_json_object("attrs_json", f"$['{ATTR_REQUIRED_METRICS}']")), F.lit(0)).alias("required"))

    out = l.active("runs").select(F.col("id").alias("run_id"), "experiment_id", "name", "kind", "status")
    out = out.join(required, "experiment_id", "left")
    for part in (by_edge, by_artifact, by_metric):
        out = out.join(part, "run_id", "left")

    def n(c):
        return F.coalesce(F.col(c), F.lit(0))

    phase = (
        F.when((n("required") > 0) & (n("metric_count") >= n("required")), "complete")
        .when((n("required") == 0) & ((n("eval_succeeded_count") > 0) | (n("has_eval_result") == 1)), "complete")
        .when(n("train_active_count") > 0, "training")
        .when(((n("train_failed") > 0) & (n("train_succeeded_count") == 0))
              | ((n("eval_failed") > 0) & (n("eval_succeeded_count") == 0)) | (n("other_failed") > 0), "failed")
        .when(n("skipped_count") > 0, "skipped")
        .when((n("train_succeeded_count") > 0) | (n("has_checkpoint") == 1), "trained")
        .when((n("eval_succeeded_count") > 0) | (n("has_eval_result") == 1), "evaluated")
        .when(n("job_edge_count") > 0, "submitted").otherwise("planned"))
    return out.select(
        "experiment_id", "run_id", "name", "kind", "status", n("has_checkpoint").alias("has_checkpoint"),
        n("has_eval_result").alias("has_eval_result"),
        *[zero(c) for c in ("metric_count", "train_active_count", "train_succeeded_count", "eval_succeeded_count",
                            "failed_count", "skipped_count", "job_edge_count")],
        phase.alias("phase"))


# --- leases ------------------------------------------------------------------

def _unreleased(l: Ledger) -> DataFrame:
    return l.table("leases").filter(F.col("released_at").isNull())


def leases_active(l: Ledger) -> DataFrame:
    return _unreleased(l).filter(F.col("expires_at").isNull() | (F.col("expires_at") > l.now)).select(
        F.col("id").alias("lease_id"), "entity_type", "entity_id", "owner_agent", "session_id", "claimed_at",
        "heartbeat_at", "expires_at", "attrs_json")


def leases_stale(l: Ledger) -> DataFrame:
    return leases_active(l).filter(F.col("heartbeat_at") < l.ago(1)).select(
        "lease_id", "entity_type", "entity_id", "owner_agent", "session_id", "claimed_at", "heartbeat_at", "expires_at",
        F.lit(1.0).alias("stale_threshold_hours"), l.hours_since(F.col("heartbeat_at")).alias("stale_hours"), "attrs_json")


def _ownership(l: Ledger, kind: str, table: str, extra: DataFrame | None = None) -> DataFrame:
    key = f"{kind}_id"
    held = _unreleased(l).filter(F.col("entity_type") == kind).select(
        F.col("entity_id").alias(key), F.col("id").alias("lease_id"), "owner_agent", "session_id", "heartbeat_at", "expires_at")
    out = l.active(table).select(F.col("id").alias(key)).join(held, key, "left")
    mid = []
    if extra is not None:
        out = out.join(extra, key, "left")
        mid = [F.coalesce("retry_depth", F.lit(0)).alias("retry_depth")]
    return out.select(key, "lease_id", "owner_agent", "session_id", "heartbeat_at", "expires_at", *mid,
                      flag(F.col("heartbeat_at") < l.ago(1)).alias("is_stale"),
                      flag(F.col("expires_at") <= l.now).alias("is_expired"))


def experiment_ownership(l: Ledger) -> DataFrame:
    return _ownership(l, "experiment", "experiments")


def run_ownership(l: Ledger) -> DataFrame:
    return _ownership(l, "run", "runs")


def job_ownership(l: Ledger) -> DataFrame:
    return _ownership(l, "job", "jobs", l.once("retry_depth", lambda: graph.retry_depth(l.table("jobs"))))


def dashboard_leases(l: Ledger) -> DataFrame:
    leases = l.table("leases")

    def rows(df, experiment):
        return df.select(F.col("id").alias("lease_id"), "entity_type", "entity_id", experiment.alias("experiment_id"),
                         "owner_agent", "session_id", "claimed_at", "heartbeat_at", "expires_at", "released_at",
                         "release_reason", "attrs_json")

    known = l.table("experiments").select(F.col("id").alias("entity_id"))
    links = l.table("experiment_runs").select(F.col("run_id").alias("link_run"), F.col("experiment_id").alias("link_exp"))
    own = l.table("jobs").select(F.col("id").alias("entity_id"), F.col("experiment_id").alias("job_exp"), F.col("run_id").alias("link_run"))
    exp = rows(leases.filter(F.col("entity_type") == "experiment").join(known, "entity_id"), F.col("entity_id"))
    run = leases.filter(F.col("entity_type") == "run").join(links, F.col("entity_id") == F.col("link_run"))
    job = leases.filter(F.col("entity_type") == "job").join(own, "entity_id").join(links, "link_run", "left")
    return exp.unionByName(rows(run, F.col("link_exp"))).unionByName(rows(job, F.coalesce("job_exp", "link_exp")))


def dashboard_external_links(l: Ledger) -> DataFrame:
    links = l.table("experiment_runs").select("run_id", F.col("experiment_id").alias("link_exp"))
    job = l.active("jobs").filter(F.lower("external_id").startswith("http")).join(links, "run_id", "left").select(
        F.coalesce("experiment_id", "link_exp").alias("experiment_id"), F.lit("job").alias("entity_type"),
        F.col("id").alias("entity_id"), "external_system", F.col("external_id").alias("url"))
    art = l.active("artifacts").filter(F.lower("uri").startswith("http")).select(
        "experiment_id", F.lit("artifact").alias("entity_type"), F.col("id").alias("entity_id"),
        F.lit(None).cast("string").alias("external_system"), F.col("uri").alias("url"))
    return job.unionByName(art)


def dashboard_runs(l: Ledger) -> DataFrame:
    return runs_progress(l)


def dashboard_jobs(l: Ledger) -> DataFrame:
    return jobs_with_recovery(l)


#: Stable views by the names a user queries.
STABLE = {f"v_{f.__name__}": f for f in (
    artifacts, notes, sync_events, experiments, runs, jobs, job_runs, validations, sessions, experiment_session_history, refresh_log, lease_history, dashboard_runs,
    dashboard_validations, dashboard_notes, dashboard_artifacts, dashboard_jobs, metrics_long, experiment_summary, run_summary, metric_coverage, jobs_needing_attention,
    artifact_latest_per_type, tracker_sync_coverage, tracker_writeback_coverage, reconcile_log, artifacts_redacted, jobs_with_recovery, experiment_blockers, runs_progress,
    leases_active, leases_stale, experiment_ownership, run_ownership, job_ownership, dashboard_leases, dashboard_external_links)}
