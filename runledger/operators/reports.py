"""Experiment reports, each computed for all experiments at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from runledger.functions import text as tx
from runledger.functions.attrs import attr_is_true, attr_number
from runledger.ledger import Ledger, conform, ts
from runledger.operators import audit, freshness, views
from runledger.operators.lifecycle import lifecycle
from runledger.operators.ownership import artifact_experiments, attach_experiments, count_if, flag, zero
from runledger.schemas import (ACTIVE_JOB_STATUSES, ATTR_BLOCKING, ATTR_ERRATUM, ATTR_EXPECTED_RUNS, ATTR_PREFIX, ATTR_REVIEWED_COUNT,
                               JOB_STATUSES, NOTE_STATUSES, NOTE_TYPES, RUN_KINDS, RUN_PHASES)

# list name -> (note type, status or None)
STATUS_NOTES = {"open_handoffs": ("handoff", "open"), "open_next_actions": ("next-action", "open"), "open_debug": ("debug", "open"),
                "recent_research": ("research", None), "recent_decisions": ("decision", None)}
CONTEXT_NOTES = {**STATUS_NOTES, "recent_checkpoints": ("checkpoint", None)}


def _lists(conditions: dict[str, Column]) -> Column:
    """Names of all lists a row belongs to, exploded."""
    return F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull()))


def top_n(df: DataFrame, keys: list, order: list[Column], limit: int | None) -> DataFrame:
    """Rows ranked per key, the first ``limit`` if given.  A limit lets Spark prune per partition before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _experiments(l: Ledger) -> DataFrame:
    return l.table("experiments").select(F.col("id").alias("experiment_id"), "name")


def _exp_notes(l: Ledger) -> DataFrame:
    return l.active("notes").filter(F.col("entity_type") == "experiment").withColumnRenamed("entity_id", "experiment_id").withColumnRenamed("id", "note_id")


# --- status --------------------------------------------------------------------

def validation_summary(l: Ledger) -> DataFrame:
    checks = l.active("validations").filter(F.col("entity_type") == "experiment")
    s = F.col("status")
    per = checks.groupBy(F.col("entity_id").alias("experiment_id")).agg(
        F.count("*").alias("total"), count_if(s == "fail").alias("failed"),
        count_if((s == "unknown") & attr_is_true(F.col("attrs_json"), ATTR_BLOCKING)).alias("unknown_blocking"),
        count_if(s == "warning").alias("warnings"))
    status = (F.when(F.col("failed") > 0, "fail").when(F.col("unknown_blocking") > 0, "unknown")
              .when(F.col("warnings") > 0, "warning").when(F.col("total") > 0, "pass").otherwise("none"))
    return _experiments(l).select("experiment_id").join(per, "experiment_id", "left").select(
        "experiment_id", status.alias("validation_status"), zero("total"), zero("failed"), zero("unknown_blocking"), zero("warnings"))


def _job_list_conditions(l: Ledger, stale_hours: float) -> dict[str, Column]:
    s = F.col("status")
    return {"stale": s.isin("queued", "running") & (F.col("updated_at") < l.ago(stale_hours)), "failed": s == "failed",
            "blocking_failed": F.col("is_blocking_failed") == 1, "recovery_in_progress": F.col("is_recovery_in_progress") == 1,
            "recovered_failed": F.col("is_recovered_failed") == 1, "submitting": s == "submitting", "unknown_submit": s == "unknown_submit"}


def experiment_status(l: Ledger, stale_hours: float = 24.0) -> DataFrame:
    """Readiness and job counts.  Only jobs naming the experiment directly count here."""
    jobs = views.jobs_with_recovery(l).filter(F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(
        *[count_if(F.col("status") == s).alias(f"jobs_{s}") for s in JOB_STATUSES],
        *[count_if(c).alias(f"n_{n}") for n, c in _job_list_conditions(l, stale_hours).items()])
    runs = views.active_links(l).groupBy("experiment_id").agg(F.count("*").alias("run_count"))
    out = _experiments(l).join(jobs, "experiment_id", "left").join(runs, "experiment_id", "left").join(validation_summary(l), "experiment_id")
    listed = {n: F.coalesce(f"n_{n}", F.lit(0).cast("bigint")) for n in _job_list_conditions(l, stale_hours)}
    active = sum((F.coalesce(F.col(f"jobs_{s}"), F.lit(0)) for s in ACTIVE_JOB_STATUSES), F.lit(0)).cast("bigint")
    blockers = listed["blocking_failed"] + F.col("failed") + F.col("unknown_blocking")
    return out.select(
        "experiment_id", "name", zero("run_count"), *[zero(f"jobs_{s}") for s in JOB_STATUSES],
        flag((blockers == 0) & (active == 0)).alias("is_ready"), flag(blockers > 0).alias("has_active_blockers"),
        blockers.alias("blocker_count"), active.alias("active_job_count"),
        listed["recovery_in_progress"].alias("recovery_in_progress_count"), listed["recovered_failed"].alias("recovered_failed_count"),
        (listed["submitting"] + listed["unknown_submit"]).alias("submission_uncertainty_count"), "validation_status",
        listed["failed"].alias("failed_list_count"), listed["stale"].alias("stale_list_count"))


def status_job_lists(l: Ledger, stale_hours: float = 24.0, limit: int | None = None) -> DataFrame:
    """Ranked jobs per experiment and list; stale lists run oldest first, the others newest first."""
    rows = views.jobs_with_recovery(l).filter(F.col("experiment_id").isNotNull()).select(
        "experiment_id", "job_id", "name", "status", "updated_at", _lists(_job_list_conditions(l, stale_hours)).alias("list_name"))
    age = F.unix_micros(F.col("updated_at").cast("timestamp"))
    key = F.when(F.col("list_name") == "stale", age).otherwise(-age)
    return top_n(rows.withColumn("_k", key), ["experiment_id", "list_name"], [F.col("_k"), F.col("job_id")], limit).select(
        "experiment_id", "list_name", "rank", "job_id", "name", "status", "updated_at")


# --- run progress ----------------------------------------------------------------

def run_progress_summary(l: Ledger) -> DataFrame:
    per = views.runs_progress(l).groupBy("experiment_id").agg(
        F.count("*").alias("total"), *[count_if(F.col("kind") == k).alias(f"kind_{k}") for k in RUN_KINDS],
        *[count_if(F.col("phase") == p).alias(f"phase_{p}") for p in RUN_PHASES],
        F.sum(F.col("has_checkpoint").cast("bigint")).alias("with_checkpoint"), F.sum(F.col("has_eval_result").cast("bigint")).alias("with_eval_result"))
    out = l.table("experiments").select(F.col("id").alias("experiment_id"),
                                        F.expr("CAST(NULL AS BIGINT)").alias("_none"), attr_number(F.col("attrs_json"), ATTR_EXPECTED_RUNS).alias("_expected"))
    expected = F.when(F.col("_expected") < 0, F.ceil("_expected")).otherwise(F.floor("_expected")).cast("bigint")
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    return out.join(per, "experiment_id", "left").select(
        "experiment_id", total.alias("total"), expected.alias("expected"),
        F.when(expected.isNotNull(), F.greatest(expected - total, F.lit(0).cast("bigint"))).alias("missing_expected_count"),
        *[zero(f"kind_{k}") for k in RUN_KINDS], *[zero(f"phase_{p}") for p in RUN_PHASES], zero("with_checkpoint"), zero("with_eval_result"))


def run_progress_by_metric(l: Ledger) -> DataFrame:
    owned = l.active("runs").filter(F.col("experiment_id").isNotNull()).select(F.col("id").alias("run_id"), "experiment_id")
    seen = l.active("metrics").groupBy("run_id", "metric_name").agg(F.lit(1).alias("_")).drop("_")
    return seen.join(owned, "run_id").groupBy("experiment_id", "metric_name").agg(F.count("*").alias("run_count"))


def run_progress_failed_examples(l: Ledger, limit: int | None = None) -> DataFrame:
    rows = views.runs_progress(l).filter((F.col("phase") == "failed") & F.col("experiment_id").isNotNull())
    return top_n(rows, ["experiment_id"], [F.col("name"), F.col("run_id")], limit).select("experiment_id", "rank", "run_id", "name")


# --- notes -------------------------------------------------------------------------

def note_counts(l: Ledger) -> DataFrame:
    """Dense note type x status counts: every experiment has all 21 cells."""
    cells = F.array(*[F.struct(F.lit(t).alias("note_type"), F.lit(s).alias("status")) for t in NOTE_TYPES for s in NOTE_STATUSES])
    grid = _experiments(l).select("experiment_id", F.explode(cells).alias("c")).select("experiment_id", "c.note_type", "c.status")
    have = _exp_notes(l).groupBy("experiment_id", "note_type", "status").agg(F.count("*").alias("note_count"))
    return grid.join(have, ["experiment_id", "note_type", "status"], "left").select("experiment_id", "note_type", "status", zero("note_count"))


def note_digest(l: Ledger, lists: dict = STATUS_NOTES, full_body: bool = False, limit: int | None = None) -> DataFrame:
    conditions = {n: (F.col("note_type") == t) & (F.lit(True) if s is None else F.col("status") == s) for n, (t, s) in lists.items()}
    slim = _exp_notes(l).select("experiment_id", "note_id", "note_type", "status", "title", "body_format", "body", "updated_at",
                                _lists(conditions).alias("list_name"))
    rows = top_n(slim, ["experiment_id", "list_name"], [F.desc("updated_at"), F.col("note_id")], limit)
    body = F.col("body") if full_body else tx.note_preview(F.col("body")).alias("body_preview")
    return rows.select("experiment_id", "list_name", "rank", "note_id", "note_type", "status", "title", "body_format", body, "updated_at")


def note_context(l: Ledger, limit: int | None = None) -> DataFrame:
    return note_digest(l, CONTEXT_NOTES, full_body=True, limit=limit)


# --- artifacts, errata, leases --------------------------------------------------------

def experiment_artifacts(l: Ledger, limit: int | None = None) -> DataFrame:
    rows = l.active("artifacts").select(F.col("id").alias("artifact_id"), "type", "uri", "updated_at").join(artifact_experiments(l), "artifact_id")
    return top_n(rows, ["experiment_id"], [F.desc("updated_at"), F.col("artifact_id")], limit).select(
        "experiment_id", "rank", "artifact_id", "type", "uri", "updated_at")


def errata_log(l: Ledger) -> DataFrame:
    def marked(table):
        return l.active(table).filter(attr_is_true(F.col("attrs_json"), ATTR_ERRATUM))

    def rows(df, kind, key):
        return df.select("owner_id", F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), "created_at")

    notes = attach_experiments(l, marked("notes").select("id", "created_at", F.col("entity_type").alias("tt"), F.col("entity_id").alias("ti")), "tt", "ti", "owner")
    checks = attach_experiments(l, marked("validations").select("id", "created_at", F.col("entity_type").alias("tt"), F.col("entity_id").alias("ti")), "tt", "ti", "owner")
    arts = marked("artifacts").select(F.col("id").alias("artifact_id"), "created_at").join(
        artifact_experiments(l).withColumnRenamed("experiment_id", "owner_id"), "artifact_id")
    return rows(notes, "note", "id").unionByName(rows(arts, "artifact", "artifact_id")).unionByName(rows(checks, "validation", "id")).withColumnRenamed(
        "owner_id", "experiment_id")


def _lease_rows(l: Ledger, df: DataFrame) -> DataFrame:
    slim = df.select(F.col("id").alias("lease_id"), F.col("entity_type").alias("tt"), F.col("entity_id").alias("ti"), "owner_agent", "heartbeat_at",
                     "expires_at", "released_at")
    return attach_experiments(l, slim, "tt", "ti", "lease").withColumnRenamed("owner_id", "experiment_id")


def lease_summary(l: Ledger, stale_hours: float = 1.0) -> DataFrame:
    per = _lease_rows(l, l.table("leases").filter(F.col("released_at").isNull())).groupBy("experiment_id").agg(
        F.count("*").alias("active_count"), count_if(F.col("heartbeat_at") < l.ago(stale_hours)).alias("stale_count"),
        count_if(F.col("expires_at") <= l.now).alias("expired_count"))
    return _experiments(l).select("experiment_id").join(per, "experiment_id", "left").select(
        "experiment_id", zero("active_count"), zero("stale_count"), zero("expired_count"))


def lease_lists(l: Ledger, stale_hours: float = 1.0, limit: int | None = None) -> DataFrame:
    held = _lease_rows(l, l.table("leases").filter(F.col("released_at").isNull()))
    conditions = {"active": F.lit(True), "stale": F.col("heartbeat_at") < l.ago(stale_hours), "expired": F.col("expires_at") <= l.now}
    rows = held.withColumn("list_name", _lists(conditions)).withColumn("_at", F.col("heartbeat_at"))
    taken = _lease_rows(l, l.table("leases").filter(F.col("release_reason") == "force_takeover")).withColumn("list_name", F.lit("force_takeovers")).withColumn("_at", F.col("released_at"))
    return top_n(rows.unionByName(taken), ["experiment_id", "list_name"], [F.desc("_at"), F.col("lease_id")], limit).select(
        "experiment_id", "list_name", "rank", "lease_id", F.col("tt").alias("entity_type"), F.col("ti").alias("entity_id"), "owner_agent",
        "heartbeat_at", "expires_at")


# --- composed reports ------------------------------------------------------------------

def _situation(l: Ledger) -> DataFrame:
    """Status, open-note counts, audit counts, freshness and leases in one row per experiment."""
    def build() -> DataFrame:
        notes = _exp_notes(l)
        kinds = {"handoff": "open_handoffs", "next-action": "open_next_actions", "debug": "open_debug"}
        open_ = notes.groupBy("experiment_id").agg(
            *[count_if((F.col("note_type") == k) & (F.col("status") == "open")).alias(n) for k, n in kinds.items()],
            count_if(F.col("note_type") == "decision").alias("decision_count"))
        scoped = audit.scoped_counts(l, audit.all_issues(l)).select("experiment_id", F.col("issue_count").alias("audit_issue_count"), F.col("ok").alias("audit_ok"))
        fresh = freshness.experiment_freshness(l).select("experiment_id", "handoff_status")
        tables = views.artifacts_redacted(l).filter((F.col("type") == "metric-table") & F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(
            F.count("*").alias("metric_table_count"))
        out = experiment_status(l)
        for part in (open_, scoped, fresh, tables, lease_summary(l)):
            out = out.join(part, "experiment_id", "left")
        filled = {c: 0 for c in ["open_handoffs", "open_next_actions", "open_debug", "decision_count", "audit_issue_count", "metric_table_count"]}
        return out.fillna({**filled, "audit_ok": 1})
    return l.once("situation", build)


def _actions(conditions: dict[str, Column], fallback: str) -> Column:
    hits = F.filter(F.array(*[F.when(c, F.lit(text)) for text, c in conditions.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, F.array(F.lit(fallback))).otherwise(hits)


def triage(l: Ledger) -> DataFrame:
    actions = _actions({
        "Inspect failed jobs and note the recovery path.": F.col("failed_list_count") > 0,
        "Refresh stale queued or running jobs.": F.col("stale_list_count") > 0,
        "Resolve or update open debug notes.": F.col("open_debug") > 0,
        "Run the audit and work through its issues.": F.col("audit_issue_count") > 0,
    }, "Nothing urgent; go on with the next planned step.")
    return _situation(l).select("experiment_id", F.col("failed_list_count").alias("failed_job_count"), F.col("stale_list_count").alias("stale_job_count"),
                                F.col("open_debug").alias("open_debug_count"), "audit_ok", "audit_issue_count", F.to_json(actions).alias("suggested_next_actions"))


def triage_artifacts(l: Ledger, limit: int | None = None) -> DataFrame:
    rows = views.artifacts_redacted(l).filter(F.col("experiment_id").isNotNull())
    return top_n(rows, ["experiment_id"], [F.desc("updated_at"), F.desc("artifact_id")], limit).select(
        "experiment_id", "rank", "artifact_id", "type", "uri_locality", "display_uri", "updated_at")


def closeout_checklist(l: Ledger) -> DataFrame:
    unresolved = F.col("open_handoffs") + F.col("open_next_actions") + F.col("open_debug")
    # id, passes when, count, noun
    items = [("audit", F.col("audit_ok") == 1, F.col("audit_issue_count"), "issue(s)"), ("failed_jobs", F.col("failed_list_count") == 0, F.col("failed_list_count"), "failed job(s)"),
             ("stale_jobs", F.col("stale_list_count") == 0, F.col("stale_list_count"), "stale job(s)"), ("unresolved_notes", unresolved == 0, unresolved, "open note(s)"),
             ("metric_table_export", F.col("metric_table_count") > 0, F.col("metric_table_count"), "metric-table artifact(s)"),
             ("decision_note", F.col("decision_count") > 0, F.col("decision_count"), "decision note(s)")]
    rows = F.array(*[F.struct(F.lit(i).alias("item_id"), flag(ok).alias("ok"), F.concat_ws(" ", n.cast("string"), F.lit(noun)).alias("detail"))
                     for i, ok, n, noun in items])
    ready = flag(F.forall(rows, lambda x: x["ok"] == 1))
    return _situation(l).select("experiment_id", ready.alias("ready"), F.explode(rows).alias("i")).select("experiment_id", "ready", "i.item_id", "i.ok", "i.detail")


def workloop_actions(l: Ledger) -> DataFrame:
    actions = _actions({
        "refresh_external_state": F.col("active_job_count") > 0, "inspect_issues": F.col("audit_issue_count") > 0,
        "write_handoff": F.col("handoff_status").isin("missing", "stale"), "resolve_leases": (F.col("stale_count") > 0) | (F.col("expired_count") > 0),
    }, "continue")
    return _situation(l).select("experiment_id", F.posexplode(actions).alias("position", "action"))


def _plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def recommended_actions(l: Ledger) -> DataFrame:
    """Which of seven follow-ups apply to each experiment, with a summary line."""
    notes = _exp_notes(l).filter((F.col("status") == "open") & F.col("note_type").isin("handoff", "next-action", "debug")).groupBy("experiment_id").agg(
        F.count("*").alias("open_notes"))
    c = F.col
    act = lambda i, cond, text: F.when(cond, F.struct(F.lit(i).alias("action_id"), text.alias("issue_summary")))
    picks = F.array(
        act("refresh-external-state", c("active_job_count") > 0, _plural(c("active_job_count"), "active job")),
        act("resolve-failed-jobs", c("blocking_failed_job_count") + c("recovery_in_progress_failed_job_count") > 0,
            F.concat_ws(", ", _plural(c("blocking_failed_job_count"), "blocking failed job"), _plural(c("recovery_in_progress_failed_job_count"), "recovering failure"))),
        act("fix-failing-validations", c("failing_validation_count") > 0, _plural(c("failing_validation_count"), "failing validation")),
        act("write-handoff", c("handoff_status").isin("missing", "stale"), F.concat(F.lit("handoff is "), c("handoff_status"))),
        act("resolve-stale-leases", c("stale_lease_count") > 0, _plural(c("stale_lease_count"), "stale lease")),
        act("review-open-notes", F.coalesce("open_notes", F.lit(0)) > 0, _plural(c("open_notes"), "open action note")),
        act("review-outputs", c("lifecycle_state") == "review", F.concat(F.lit("unreviewed activity at "), F.date_format("last_reviewable_activity_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))))
    return lifecycle(l).join(notes, "experiment_id", "left").select(
        "experiment_id", F.explode(F.filter(picks, lambda x: x.isNotNull())).alias("a")).select("experiment_id", "a.action_id", "a.issue_summary")


# --- cleanup, handoffs, reviews: change sets ----------------------------------------------

def cleanup_plan(l: Ledger, limit: int | None = None) -> DataFrame:
    """Open debug notes of recovered jobs and failing validations with a later pass, ranked per experiment."""
    done = views.jobs_with_recovery(l).filter((F.col("is_recovered_failed") == 1) & F.col("experiment_id").isNotNull()).select("job_id", "experiment_id")
    debug = l.active("notes").filter((F.col("entity_type") == "job") & (F.col("note_type") == "debug") & (F.col("status") == "open")).select(
        F.col("entity_id").alias("job_id"), F.col("id").alias("entity_id"), "updated_at", F.coalesce("title", tx.note_preview(F.col("body"))).alias("label"))
    notes = top_n(debug.join(done, "job_id"), ["experiment_id"], [F.desc("updated_at"), F.col("entity_id")], limit).select(
        "experiment_id", F.lit("debug_note").alias("plan"), "rank", "entity_id", "label")
    checks = l.active("validations").filter(F.col("entity_type") == "experiment")
    passed = checks.filter(F.col("status") == "pass").groupBy("entity_id", "check_name").agg(F.max("updated_at").alias("passed_at"))
    old = checks.filter(F.col("status").isin("fail", "warning", "unknown")).join(passed, ["entity_id", "check_name"]).filter(F.col("passed_at") >= F.col("updated_at"))
    superseded = top_n(old.withColumnRenamed("entity_id", "experiment_id"), ["experiment_id"], [F.col("check_name"), F.desc("updated_at"), F.desc("id")], limit).select(
        "experiment_id", F.lit("superseded_validation").alias("plan"), "rank", F.col("id").alias("entity_id"), F.col("check_name").alias("label"))
    return notes.unionByName(superseded)


def _new_note_id(*parts: Column) -> Column:
    return F.concat(F.lit("note_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def apply_cleanup(l: Ledger, plan: DataFrame | None = None) -> dict[str, DataFrame]:
    """New ``notes`` and ``validations`` tables with the plan carried out on active experiments,
    plus one checkpoint note per changed experiment."""
    live = l.active("experiments").select(F.col("id").alias("experiment_id"))
    plan = (cleanup_plan(l) if plan is None else plan).join(live, "experiment_id", "left_semi")
    done_notes = plan.filter(F.col("plan") == "debug_note").select(F.col("entity_id").alias("id"), F.lit(True).alias("hit")).distinct()
    done_checks = plan.filter(F.col("plan") == "superseded_validation").select(F.col("entity_id").alias("id"), F.lit(True).alias("hit")).distinct()
    hit = F.col("hit").isNotNull()
    notes = l.table("notes").join(done_notes, "id", "left").withColumn("status", F.when(hit, "resolved").otherwise(F.col("status"))).withColumn(
        "resolved_at", F.when(hit, l.now).otherwise(F.col("resolved_at"))).withColumn("updated_at", F.when(hit, l.now).otherwise(F.col("updated_at")))
    checks = l.table("validations").join(done_checks, "id", "left").withColumn("deleted_at", F.when(hit, F.coalesce("deleted_at", l.now)).otherwise(F.col("deleted_at"))).withColumn(
        "updated_at", F.when(hit, l.now).otherwise(F.col("updated_at")))
    # The note has counts only: the items are the plan's rows, of which there is no bound.
    lines = plan.groupBy("experiment_id").agg(
        count_if(F.col("plan") == "debug_note").alias("n_notes"), count_if(F.col("plan") == "superseded_validation").alias("n_checks"))
    body = F.concat_ws("\n", F.lit("# Cleanup"), F.concat(F.lit("- Debug notes resolved: "), F.col("n_notes")),
                       F.concat(F.lit("- Validations archived: "), F.col("n_checks")))
    fresh = lines.select(_new_note_id(F.lit("cleanup"), F.col("experiment_id"), F.lit(str(l.as_of))).alias("id"), F.lit("experiment").alias("entity_type"),
                         F.col("experiment_id").alias("entity_id"), F.lit("checkpoint").alias("note_type"), F.lit("open").alias("status"),
                         F.lit("Experiment cleanup").alias("title"), body.alias("body"), F.lit("markdown").alias("body_format"),
                         l.now.alias("created_at"), l.now.alias("updated_at"), F.lit('{"' + ATTR_PREFIX + 'cleanup":true}').alias("attrs_json"))
    return {"notes": conform(notes.drop("hit"), "notes").unionByName(conform(fresh, "notes")), "validations": conform(checks.drop("hit"), "validations")}


def handoff_examples(l: Ledger, limit: int | None = None) -> DataFrame:
    """(experiment_id, section, rank, entity_id, label): the drifted artifacts and stale validations behind a handoff, newest first."""
    drift = freshness.drift(l).select("artifact_id", "uri", "drift_kind", "updated_at").join(freshness.drift_owners(l), "artifact_id").select(
        "experiment_id", F.lit("drifted_artifact").alias("section"), F.col("artifact_id").alias("entity_id"),
        F.concat("uri", F.lit(" ("), "drift_kind", F.lit(")")).alias("label"), "updated_at")
    checks = freshness.experiment_stale_validations(l).select(
        F.col("entity_id").alias("experiment_id"), F.lit("stale_validation").alias("section"), F.col("validation_id").alias("entity_id"), F.col("check_name").alias("label"), "updated_at")
    return top_n(drift.unionByName(checks), ["experiment_id", "section"], [F.desc("updated_at"), F.col("entity_id")], limit).select(
        "experiment_id", "section", "rank", "entity_id", "label")


def handoff_notes(l: Ledger, stale_hours: float = 24.0) -> DataFrame:
    """One checkpoint note row per active experiment with its freshness figures; ``handoff_examples`` has the rows behind them."""
    rows = freshness.experiment_freshness(l, stale_hours).filter(F.col("deleted_at").isNull())
    body = F.concat_ws("\n", F.lit("# Experiment Handoff\n\n## Freshness\n"), F.concat(F.lit("- Handoff status: `"), "handoff_status", F.lit("`")),
                       F.concat(F.lit("- Drifted artifacts: "), F.col("drifted_artifact_count")), F.concat(F.lit("- Stale validations: "), F.col("stale_validation_count")), F.lit(""))
    return conform(rows.select(
        _new_note_id(F.lit("handoff"), F.col("experiment_id"), F.lit(str(l.as_of))).alias("id"), F.lit("experiment").alias("entity_type"),
        F.col("experiment_id").alias("entity_id"), F.lit("checkpoint").alias("note_type"), F.lit("open").alias("status"), F.lit("Experiment handoff").alias("title"),
        body.alias("body"), F.lit("markdown").alias("body_format"), l.now.alias("created_at"), l.now.alias("updated_at"), F.lit("{}").alias("attrs_json")), "notes")


def archive_experiments(l: Ledger, ids: DataFrame) -> DataFrame:
    """Experiments table with the given ``id`` rows archived; the first archive time stays."""
    hit = F.col("_hit").isNotNull()
    marked = l.table("experiments").join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    return marked.withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))).withColumn(
        "deleted_at", F.when(hit, F.coalesce("deleted_at", l.now)).otherwise(F.col("deleted_at"))).withColumn(
        "updated_at", F.when(hit, l.now).otherwise(F.col("updated_at"))).select(*l.table("experiments").columns)


def write_handoffs(l: Ledger, archive: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables with a handoff note on every active experiment, optionally archiving some of them."""
    out = {"notes": l.table("notes").unionByName(handoff_notes(l))}
    if archive is not None:
        out["experiments"] = archive_experiments(l, archive)
    return out


def mark_reviewed(l: Ledger) -> DataFrame:
    """Review note rows recording each active experiment's activity count and latest key."""
    rows = lifecycle(l).filter(F.col("deleted_at").isNull())
    key = F.concat_ws(" ", F.date_format("last_reviewable_activity_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "last_reviewable_activity_id")
    attrs = F.concat(F.lit('{"' + ATTR_PREFIX + 'review":true,"' + ATTR_REVIEWED_COUNT + '":'), F.col("reviewable_activity_count"),
                     F.lit(',"' + ATTR_PREFIX + 'reviewed_activity_key":'),
                     F.when(F.col("last_reviewable_activity_id").isNull(), "null").otherwise(F.concat(F.lit('"'), key, F.lit('"'))),
                     F.lit(f',"{ATTR_PREFIX}reviewed_at":"{l.as_of.isoformat()}Z"}}'))
    return conform(rows.select(
        _new_note_id(F.lit("review"), F.col("experiment_id"), F.lit(str(l.as_of))).alias("id"), F.lit("experiment").alias("entity_type"),
        F.col("experiment_id").alias("entity_id"), F.lit("review").alias("note_type"), F.lit("resolved").alias("status"), F.lit("Experiment reviewed").alias("title"),
        F.lit("Reviewed the current outputs of the experiment.").alias("body"), F.lit("markdown").alias("body_format"), l.now.alias("created_at"),
        l.now.alias("updated_at"), attrs.alias("attrs_json")), "notes")


# --- lists, logs, references ------------------------------------------------------------------

def _filtered(df: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _maybe_active(l: Ledger, table: str, include_archived: bool) -> DataFrame:
    return l.table(table) if include_archived else l.active(table)


def list_experiments(l: Ledger, tag: str | None = None, include_archived: bool = False) -> DataFrame:
    df = _maybe_active(l, "experiments", include_archived)
    if tag:
        tagged = l.table("experiment_tags").filter(F.col("tag") == tag.strip().lower()).select(F.col("experiment_id").alias("id"))
        df = df.join(tagged, "id", "left_semi")
    return df.orderBy(F.desc("updated_at"), "id")


def list_runs(l: Ledger, experiment_id: str | None = None, include_archived: bool = False) -> DataFrame:
    df = _maybe_active(l, "runs", include_archived)
    if experiment_id:
        links = l.table("experiment_runs").filter(F.col("experiment_id") == experiment_id).select(F.col("run_id").alias("id"))
        df = df.join(links, "id", "left_semi")
    return df.orderBy(F.desc("updated_at"), "id")


def list_jobs(l: Ledger, experiment_id=None, run_id=None, status=None, include_archived: bool = False) -> DataFrame:
    return _filtered(_maybe_active(l, "jobs", include_archived), experiment_id=experiment_id, run_id=run_id, status=status).orderBy(F.desc("updated_at"), "id")


def list_artifacts(l: Ledger, experiment_id=None, run_id=None, job_id=None, artifact_type=None, include_archived: bool = False) -> DataFrame:
    if experiment_id and not run_id and not job_id and not include_archived:
        owned = artifact_experiments(l).filter(F.col("experiment_id") == experiment_id).select(F.col("artifact_id").alias("id"))
        df = _filtered(l.active("artifacts").join(owned, "id", "left_semi"), type=artifact_type)
    else:
        df = _filtered(_maybe_active(l, "artifacts", include_archived), experiment_id=experiment_id, run_id=run_id, job_id=job_id, type=artifact_type)
    return df.orderBy(F.desc("updated_at"), "id")


def list_metrics(l: Ledger, run_id=None, metric_name=None, include_archived: bool = False) -> DataFrame:
    return _filtered(_maybe_active(l, "metrics", include_archived), run_id=run_id, metric_name=metric_name).orderBy("run_id", "metric_name", "step", "split")


def list_notes(l: Ledger, entity_type=None, entity_id=None, note_type=None, status=None, include_archived: bool = False) -> DataFrame:
    return _filtered(_maybe_active(l, "notes", include_archived), entity_type=entity_type, entity_id=entity_id, note_type=note_type, status=status).orderBy(
        F.desc("updated_at"), "id")


def list_validations(l: Ledger, entity_type=None, entity_id=None, status=None, include_archived: bool = False) -> DataFrame:
    return _filtered(_maybe_active(l, "validations", include_archived), entity_type=entity_type, entity_id=entity_id, status=status).orderBy(F.desc("updated_at"), "id")


def list_sessions(l: Ledger, experiment_id=None, agent=None, open_only: bool = False, limit: int | None = None) -> DataFrame:
    df = _filtered(l.table("sessions"), experiment_id=experiment_id, agent=agent)
    if open_only:
        df = df.filter(F.col("ended_at").isNull())
    return _first(df.orderBy(F.desc("started_at"), F.desc("id")), limit)


def list_leases(l: Ledger, entity_type=None, entity_id=None, owner_agent=None, include_released: bool = False, limit: int | None = None) -> DataFrame:
    df = _filtered(l.table("leases"), entity_type=entity_type, entity_id=entity_id, owner_agent=owner_agent)
    if not include_released:
        df = df.filter(F.col("released_at").isNull())
    return _first(df.orderBy(F.desc("heartbeat_at"), "id"), limit)


def _log(df: DataFrame, at: str, key: str, since: datetime | None, before: datetime | None, limit: int | None) -> DataFrame:
    if since is not None:
        df = df.filter(F.col(at) >= ts(since))
    if before is not None:
        df = df.filter(F.col(at) < ts(before))
    return _first(df.orderBy(F.desc(at), F.desc(key)), limit)


def reconcile_log(l: Ledger, source=None, since=None, before=None, limit: int | None = None) -> DataFrame:
    return _log(_filtered(l.table("reconcile_events"), source=source), "created_at", "id", since, before, limit)


def refresh_log(l: Ledger, source=None, status=None, since=None, before=None, limit: int | None = None) -> DataFrame:
    return _log(_filtered(views.refresh_log(l), source=source, status=status), "finished_at", "refresh_event_id", since, before, limit)


def writeback_log(l: Ledger, target_system=None, status=None, run_id=None, target_identifier=None, origin="writeback", source_entity_id=None, limit: int | None = None) -> DataFrame:
    df = _filtered(l.table("sync_events"), target_system=target_system, status=status, run_id=run_id, target_identifier=target_identifier,
                   origin=origin or "writeback", source_entity_id=source_entity_id)
    return _log(df, "created_at", "id", None, None, limit)


def resolve_refs(l: Ledger, table: str, refs: DataFrame) -> DataFrame:
    """Resolve ``ref`` by id, else by a unique active name.  status: ok, ambiguous or missing."""
    by_id = l.table(table).select(F.col("id").alias("ref"), F.col("id").alias("_direct"))
    by_name = l.active(table).filter(F.col("name").isNotNull()).groupBy(F.col("name").alias("ref")).agg(F.count("*").alias("_n"), F.min("id").alias("_named"))
    out = refs.select("ref").distinct().join(by_id, "ref", "left").join(by_name, "ref", "left")
    resolved = F.coalesce("_direct", F.when(F.col("_n") == 1, F.col("_named")))
    status = F.when(resolved.isNotNull(), "ok").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return out.select("ref", resolved.alias("id"), status.alias("status"))
