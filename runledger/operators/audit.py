"""Audit rules: each yields rows of one ``issues`` schema; the runner unions them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import text as tx
from runledger.functions.attrs import attr_is_true, attr_number, is_json, is_json_object
from runledger.ledger import Ledger
from runledger.lineage import cut
from runledger.operators import freshness, graph, views
from runledger.operators.ownership import artifact_experiments, count_if, job_experiments, run_experiments, union_all
from runledger.schemas import (ATTR_ERRATUM, ATTR_EXPECTED_RUNS, ATTR_TABLES, ENTITY_TABLE, SCHEMA_VERSION, SECRET_PATTERNS,
                               TERMINAL_JOB_STATUSES)

ISSUE_COLUMNS = ["code", "severity", "entity_type", "entity_id", "message", "details", "suggested_next_action"]


@dataclass(frozen=True)
class Thresholds:
    stale_hours: float = 24.0
    lease_hours: float = 1.0
    session_hours: float = 24.0
    submitting_hours: float = 1.0
    unknown_submit_hours: float = 6.0
    retry_loop: int = 3
    snapshot_days: float = 30.0


@dataclass(frozen=True)
class RowCheck:
    """A condition on the columns of one table row, with what to report about it."""

    table: str
    kind: str
    when: Column
    details: Column
    live_only: bool = True


@dataclass(frozen=True)
class Rule:
    code: str
    check: str
    severity: str
    message: str
    action: str
    # Rows found by joins or groups; entity_type, entity_id, details.
    # None if the ledger lacks what the rule looks at.
    find: Callable[[Ledger, Thresholds], DataFrame | None] | None = None
    # Checks that need one row only; fused into a single scan per table.
    rows: Callable[[Ledger, Thresholds], list[RowCheck]] | None = None

    def label(self, found_rows: DataFrame) -> DataFrame:
        return found_rows.select(
            F.lit(self.code).alias("code"), F.lit(self.severity).alias("severity"), "entity_type", "entity_id",
            F.lit(self.message).alias("message"), "details", F.lit(self.action).alias("suggested_next_action"))

    def issues(self, ledger: Ledger, limits: Thresholds) -> DataFrame:
        parts = [self.label(df)] if self.find and (df := self.find(ledger, limits)) is not None else []
        if self.rows:
            parts += scan_tables(ledger, [(self, c) for c in self.rows(ledger, limits)])
        return union_all(parts)


RULES: dict[str, Rule] = {}


def rule(code: str, check: str, severity: str, message: str, action: str):
    def wrap(fn):
        RULES[code] = Rule(code, check, severity, message, action, find=fn)
        return fn
    return wrap


def row_rule(code: str, check: str, severity: str, message: str, action: str, find=None):
    def wrap(fn):
        RULES[code] = Rule(code, check, severity, message, action, find=find, rows=fn)
        return fn
    return wrap


def scan_tables(l: Ledger, checks: list[tuple[Rule, RowCheck]]) -> list[DataFrame]:
    """One pass per table: every row yields the issues of all checks it meets."""
    by_table: dict[str, list[tuple[Rule, RowCheck]]] = {}
    for r, c in checks:
        by_table.setdefault(c.table, []).append((r, c))
    out = []
    for table, group in by_table.items():
        df = l.table(table)
        soft = "deleted_at" in df.columns
        if soft and all(c.live_only for _r, c in group):
            df, soft = l.active(table), False
        live = F.col("deleted_at").isNull() if soft else F.lit(True)
        key = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
        meets = [c.when & live if c.live_only else c.when for _r, c in group]
        hits = F.filter(F.array(*[
            F.when(met, F.struct(
                F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(c.kind).cast("string").alias("entity_type"), key.alias("entity_id"),
                F.lit(r.message).alias("message"), c.details.alias("details"), F.lit(r.action).alias("suggested_next_action")))
            for met, (r, c) in zip(meets, group, strict=True)]), lambda h: h.isNotNull())
        # rows that meet nothing, usually nearly all, never get to the list of hits
        out.append(df.filter(reduce(or_, meets)).select(F.explode(hits).alias("h")).select("h.*"))
    return out


def stamp(column: str) -> Column:
    """Timestamp as UTC text, the form used inside details."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(column)


def details(*cols) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("details")


def found(df: DataFrame, kind: str | Column, key: str | Column | None, *cols) -> DataFrame:
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    key_col = F.lit(None).cast("string") if key is None else F.col(key) if isinstance(key, str) else key
    return df.select(kind_col.alias("entity_type"), key_col.alias("entity_id"), details(*cols))


# --- attributes, notes, artifacts ---------------------------------------------

@row_rule("attrs.invalid_json", "attrs-json", "error", "attribute column does not hold a JSON object",
          "Correct the attributes with a reconcile update.")
def invalid_attrs(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return [RowCheck(t, kind, ~is_json_object(F.col("attrs_json")), details(F.lit(t).alias("table")), live_only=False)
            for t, kind in ATTR_TABLES.items()]


@rule("dangling.note_entity", "note-entity", "error", "note target is missing or archived",
      "Retarget or archive the note.")
def dangling_notes(l: Ledger, _t: Thresholds) -> DataFrame:
    notes = l.active("notes").select("id", "entity_type", "entity_id", "attrs_json")
    parts = []
    for kind, table in ENTITY_TABLE.items():
        target = l.table(table).select(F.col("id").alias("entity_id"), F.lit(1).alias("known"), F.col("deleted_at").isNotNull().alias("gone"))
        parts.append(notes.filter(F.col("entity_type") == kind).join(target, "entity_id", "left"))
    other = notes.filter(~F.col("entity_type").isin(list(ENTITY_TABLE))).withColumn("known", F.lit(None).cast("int")).withColumn(
        "gone", F.lit(None).cast("boolean"))
    joined = union_all([*parts, other]).withColumn("missing", F.col("known").isNull()).withColumn("gone", F.coalesce("gone", F.lit(False)))
    bad = joined.filter(F.col("missing") | (F.col("gone") & ~attr_is_true(F.col("attrs_json"), ATTR_ERRATUM)))
    return found(bad, "note", "id", F.col("entity_type").alias("target_entity_type"), F.col("entity_id").alias("target_entity_id"),
                 F.col("missing").alias("target_missing"), F.col("gone").alias("target_deleted"))


@rule("artifact.local_missing", "local-artifacts", "error", "file of a local artifact was not found",
      "Restore the file, fix the URI or archive the artifact.")
def local_missing(l: Ledger, _t: Thresholds) -> DataFrame:
    arts = l.active("artifacts").select("id", "uri", freshness.normal_path(tx.local_path(F.col("uri"))).alias("path")).filter(
        F.col("path").isNotNull())
    return found(arts.join(freshness.observed_files(l).select("path"), "path", "left_anti"), "artifact", "id", "uri", "path")


# --- jobs, external ids, sync events -------------------------------------------

@rule("job.stale_active", "stale-jobs", "warning", "active job shows no recent update",
      "Refresh the external job state.")
def stale_jobs(l: Ledger, t: Thresholds) -> DataFrame:
    cutoff = l.ago(t.stale_hours)
    old = l.active("jobs").filter(F.col("status").isin("queued", "running") & (F.col("updated_at") < cutoff))
    recent = l.table("sync_events").filter(F.col("job_id").isNotNull() & (F.col("created_at") >= cutoff)).select(F.col("job_id").alias("id"))
    return found(old.join(recent, "id", "left_anti"), "job", "id", "status", stamp("updated_at"), F.lit(t.stale_hours).alias("stale_hours"))


def _external_rows(l: Ledger, table: str, kind: str) -> DataFrame:
    return l.table(table).filter(F.col("external_system").isNotNull() & F.col("external_id").isNotNull()).select(
        F.lit(kind).alias("entity_type"), "external_system", "external_id", "id", F.col("deleted_at").isNull().alias("live"))


def _shared_ids(l: Ledger) -> DataFrame:
    """External identifiers that an active row shares with another row, one row each; stored once for both rules."""
    def build() -> DataFrame:
        rows = union_all([_external_rows(l, "runs", "run"), _external_rows(l, "jobs", "job")])
        live_id, gone_id = F.when(F.col("live"), F.col("id")), F.when(~F.col("live"), F.col("id"))
        groups = rows.groupBy("entity_type", "external_system", "external_id").agg(
            F.count(live_id).alias("n"), F.min(live_id).alias("first_id"), F.max(live_id).alias("last_id"), F.count(gone_id).alias("archived_count"), F.min(gone_id).alias("archived_id"))
        return cut(groups.filter("n > 1 OR (n > 0 AND archived_count > 0)"), "shared-ids")
    return l.once("shared_ids", build)


@rule("external_id.duplicate_active", "external-ids", "error", "several active rows carry one external identifier",
      "Archive or correct the duplicates.")
def duplicate_active(l: Ledger, _t: Thresholds) -> DataFrame:
    return found(_shared_ids(l).filter("n > 1"), F.col("entity_type"), None, "external_system", "external_id", "n", "first_id", "last_id")


@rule("external_id.duplicate_archived", "external-ids", "warning", "active row carries the external identifier of an archived row",
      "Check that the archived row is history and not a mistake.")
def duplicate_archived(l: Ledger, _t: Thresholds) -> DataFrame:
    """One issue per active row; the archived side is combined first, so no pair list is formed."""
    key = ["entity_type", "external_system", "external_id"]
    gone = _shared_ids(l).filter("archived_count > 0").select(*key, "archived_count", "archived_id")
    both = union_all([_external_rows(l, "runs", "run"), _external_rows(l, "jobs", "job")]).filter("live").join(gone, key)
    return found(both, F.col("entity_type"), "id", "external_system", "external_id", F.col("id").alias("active_id"), "archived_id", "archived_count")


def duplicate_members(l: Ledger) -> DataFrame:
    """Every row of every external identifier held by more than one row (whole groups, one row each)."""
    rows = union_all([_external_rows(l, "runs", "run"), _external_rows(l, "jobs", "job")])
    key = ["entity_type", "external_system", "external_id"]
    shared = rows.groupBy(*key).agg(F.count("*").alias("n"), count_if(F.col("live")).alias("active_n")).filter("n > 1 AND active_n > 0")
    return rows.join(shared, key).select(*key, F.col("id").alias("entity_id"), F.col("live").cast("int").alias("is_active"))


@rule("sync_event.dangling_entity", "sync-events", "warning", "sync event points at an archived run or job",
      "Check whether the event is still wanted as provenance.")
def sync_dangling(l: Ledger, _t: Thresholds) -> DataFrame:
    runs = l.table("runs").filter(F.col("deleted_at").isNotNull()).select(F.col("id").alias("run_id"), F.col("deleted_at").alias("run_deleted_at"))
    jobs = l.table("jobs").filter(F.col("deleted_at").isNotNull()).select(F.col("id").alias("job_id"), F.col("deleted_at").alias("job_deleted_at"))
    rows = l.table("sync_events").select("id", "run_id", "job_id").join(runs, "run_id", "left").join(jobs, "job_id", "left")
    return found(rows.filter(F.col("run_deleted_at").isNotNull() | F.col("job_deleted_at").isNotNull()), "sync_event", "id", "run_id", "job_id",
                 stamp("run_deleted_at"), stamp("job_deleted_at"))


@rule("sync_event.duplicate_idempotency_key", "sync-events", "warning", "sync events repeat an idempotency key",
      "Look at the repeated events and the manifest source.")
def sync_duplicates(l: Ledger, _t: Thresholds) -> DataFrame:
    groups = l.table("sync_events").filter((F.col("origin") == "manifest") & F.col("idempotency_key").isNotNull()).groupBy(
        "target_system", F.coalesce("target_identifier", F.lit("")).alias("target_identifier"), "idempotency_key").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")
    return found(groups, "sync_event", None, "target_system", "target_identifier", "idempotency_key", "n", "first_id", "last_id")


@rule("sync_event.failed_writeback", "sync-events", "warning", "latest writeback attempt failed",
      "Read the error and run the writeback again.")
def failed_writeback(l: Ledger, t: Thresholds) -> DataFrame:
    fields = ["created_at", "id", "status", "run_id", "source_entity_id", "target_identifier", "target_field", "error_message"]
    last = l.table("sync_events").filter((F.col("origin") == "writeback") & F.col("idempotency_key").isNotNull()).groupBy(
        "target_system", F.coalesce("target_identifier", F.lit("")).alias("_target"), "idempotency_key").agg(
        F.max(F.struct(*fields)).alias("e")).select("e.*")
    bad = last.filter((F.col("status") == "failed") & (F.col("created_at") <= l.ago(t.stale_hours)))
    return found(bad, "sync_event", "id", "id", "run_id", "source_entity_id", "target_identifier", "target_field", "error_message", stamp("created_at"))


def orphan_operations(l: Ledger, _t: Thresholds) -> DataFrame:
    known = l.table("reconcile_events").select(F.col("id").alias("reconcile_event_id"))
    orphan = l.table("reconcile_operations").select("id", "reconcile_event_id").join(known, "reconcile_event_id", "left_anti")
    return found(orphan, "reconcile_operation", "id", "id", "reconcile_event_id")


@row_rule("reconcile_log.anomaly", "reconcile-log", "error", "reconcile log row is damaged", "Inspect the log rows.", find=orphan_operations)
def reconcile_anomaly(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    cols = {"reconcile_events": ["inserts_json", "updates_json", "counts_json", "attrs_json"], "reconcile_operations": ["input_json", "diff_json"]}
    return [RowCheck(t, t[:-1], ~is_json(F.col(c)), details(F.lit(t).alias("table"), F.lit(c).alias("column")))
            for t, names in cols.items() for c in names]


@row_rule("session.stale_open", "stale-sessions", "warning", "open session shows no recent activity",
          "End the session if it is over.")
def stale_sessions(l: Ledger, t: Thresholds) -> list[RowCheck]:
    return [RowCheck("sessions", "session", F.col("ended_at").isNull() & (F.col("last_touch_at") < l.ago(t.session_hours)),
                     details("experiment_id", "agent", "cwd", stamp("started_at"), stamp("last_touch_at"),
                             F.lit(t.session_hours).alias("stale_session_hours")))]


# --- retry lineage ---------------------------------------------------------------

def _stuck(l: Ledger, status: str, hours: float) -> list[RowCheck]:
    return [RowCheck("jobs", "job", (F.col("status") == status) & (F.col("updated_at") < l.ago(hours)), details("status", stamp("updated_at")))]


@row_rule("job_submission.submitting_stale", "job-recovery", "warning", "submission is still unacknowledged",
          "Refresh the job or set its status.")
def submitting_stale(l: Ledger, t: Thresholds) -> list[RowCheck]:
    return _stuck(l, "submitting", t.submitting_hours)


@row_rule("job_submission.unknown_stale", "job-recovery", "warning", "ambiguous submission is still unsettled",
          "Refresh the job, mark it failed, or submit a retry.")
def unknown_stale(l: Ledger, t: Thresholds) -> list[RowCheck]:
    return _stuck(l, "unknown_submit", t.unknown_submit_hours)


@rule("job_retry.missing_target", "job-recovery", "error", "retry points at a missing or archived job",
      "Correct the retry lineage.")
def retry_missing(l: Ledger, _t: Thresholds) -> DataFrame:
    bad = l.active("jobs").filter(F.col("retry_of").isNotNull()).select("id", "retry_of").join(graph.edges(l).select("id"), "id", "left_anti")
    return found(bad, "job", "id", "retry_of")


@rule("job_retry.cycle", "job-recovery", "error", "retry lineage runs in a circle",
      "Break the circle.")
def retry_cycle(l: Ledger, _t: Thresholds) -> DataFrame:
    """One issue per cycle, reported at its smallest member id."""
    rings = graph.cycles(l).groupBy("cycle_id").agg(F.count("*").alias("length"))
    return found(rings, "job", "cycle_id", "length")


@rule("job_retry.loop", "job-recovery", "warning", "long retry chain without a success",
      "Inspect the chain before the next retry.")
def retry_loop(l: Ledger, t: Thresholds) -> DataFrame:
    failed = l.active("jobs").filter(F.col("status") == "failed").select("id")
    long = graph.retry_heights(l).filter((F.col("depth") > t.retry_loop) & ~F.col("success"))
    return found(long.join(failed, "id"), "job", "id", F.col("id").alias("root_id"), F.col("depth").alias("max_retry_depth"),
                 F.lit(t.retry_loop).alias("retry_loop_threshold"))


def _recovered(l: Ledger) -> DataFrame:
    """Failed jobs with a succeeded or active retry below them; stored once for both rules."""
    def build() -> DataFrame:
        failed = l.active("jobs").filter(F.col("status") == "failed").select(F.col("id").alias("job_id"), "experiment_id")
        below = graph.retry_recovery(l).select(F.col("root_id").alias("job_id"), "success_descendant_id", "active_descendant_id")
        return cut(failed.join(below, "job_id"), "recovered-jobs")
    return l.once("recovered_jobs", build)


@rule("job_retry.recovery_stale", "job-recovery", "warning", "recovery of a failed job shows no recent update",
      "Refresh the retry or mark it failed.")
def recovery_stale(l: Ledger, t: Thresholds) -> DataFrame:
    open_ = _recovered(l).filter("success_descendant_id IS NULL").select("job_id", "active_descendant_id")
    child = l.table("jobs").select(F.col("id").alias("active_descendant_id"), "status", "updated_at")
    rows = open_.join(child, "active_descendant_id").filter(F.col("updated_at") < l.ago(t.stale_hours))
    return found(rows, "job", "job_id", F.col("job_id").alias("failed_job_id"), "active_descendant_id", "status", stamp("updated_at"))


@rule("job_retry.recovered_debug_open", "job-recovery", "warning", "recovered job still has an open debug note",
      "Resolve or supersede the note.")
def recovered_debug_open(l: Ledger, _t: Thresholds) -> DataFrame:
    done = _recovered(l).filter("success_descendant_id IS NOT NULL").select("job_id", "experiment_id", "success_descendant_id")
    debug = l.active("notes").filter((F.col("note_type") == "debug") & (F.col("status") == "open"))
    on_job = debug.filter(F.col("entity_type") == "job").select(F.col("entity_id").alias("job_id"))
    on_exp = debug.filter(F.col("entity_type") == "experiment").select(F.col("entity_id").alias("experiment_id"))
    rows = done.join(on_job, "job_id", "left_semi").unionByName(
        done.join(on_job, "job_id", "left_anti").join(on_exp, "experiment_id", "left_semi"))
    return found(rows, "job", "job_id", "job_id", "experiment_id", "success_descendant_id")


# --- validations, leases -----------------------------------------------------------

def _validation(condition: Column) -> list[RowCheck]:
    return [RowCheck("validations", "validation", condition, details("id", "entity_type", "entity_id", "check_name", "status"))]


@row_rule("validation.failed", "validations", "warning", "validation fails", "Read the evidence and fix or rerun the step.")
def validation_failed(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return _validation(F.col("status") == "fail")


@row_rule("validation.unknown_blocking", "validations", "warning", "blocking validation has no known result", "Run the check again.")
def validation_unknown(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return _validation((F.col("status") == "unknown") & F.contains("attrs_json", F.lit(views.BLOCKING_TEXT)))


def _held(l: Ledger) -> DataFrame:
    return l.table("leases").filter(F.col("released_at").isNull())


_LEASE_FIELDS = ["id", "entity_type", "entity_id", "owner_agent", "session_id"]


def _lease_details() -> Column:
    return details(*_LEASE_FIELDS, stamp("heartbeat_at"), stamp("expires_at"))


def _lease_issue(df: DataFrame) -> DataFrame:
    return df.select(F.lit("lease").alias("entity_type"), F.col("id").alias("entity_id"), _lease_details())


@row_rule("lease.stale_heartbeat", "leases", "warning", "lease heartbeat is old", "Renew, release or take over the lease.")
def lease_stale(l: Ledger, t: Thresholds) -> list[RowCheck]:
    return [RowCheck("leases", "lease", F.col("released_at").isNull() & (F.col("heartbeat_at") < l.ago(t.lease_hours)), _lease_details())]


@row_rule("lease.expired", "leases", "warning", "lease expired without release", "Release or claim the lease.")
def lease_expired(l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return [RowCheck("leases", "lease", F.col("released_at").isNull() & (F.col("expires_at") <= l.now), _lease_details())]


def _lease_sessions(l: Ledger, how: str) -> DataFrame:
    ended = l.table("sessions").select(F.col("id").alias("session_id"), "ended_at")
    return _held(l).filter(F.nullif("session_id", F.lit("")).isNotNull()).join(ended, "session_id", how)


@rule("lease.outlived_session", "leases", "warning", "lease outlived its session", "Release the lease or claim it again.")
def lease_outlived(l: Ledger, _t: Thresholds) -> DataFrame:
    return _lease_issue(_lease_sessions(l, "inner").filter(F.col("ended_at").isNotNull()))


def _lease_targets(l: Ledger) -> DataFrame:
    """Held leases with their target; targets are reduced to the leases' own first.  Stored once for both rules."""
    def build() -> DataFrame:
        held, parts = _held(l), []
        for kind in ("experiment", "run", "job"):
            own = held.filter(F.col("entity_type") == kind)
            target = l.table(ENTITY_TABLE[kind]).select(F.col("id").alias("entity_id"), F.lit(1).alias("known"), F.col("deleted_at").alias("gone_at"))
            parts.append(own.join(target.join(own.select("entity_id").distinct(), "entity_id", "left_semi"), "entity_id", "left"))
        none = held.filter(~F.col("entity_type").isin("experiment", "run", "job"))
        parts.append(none.withColumn("known", F.lit(None).cast("int")).withColumn("gone_at", F.lit(None).cast("timestamp_ntz")))
        return cut(union_all(parts).filter(F.col("known").isNull() | F.col("gone_at").isNotNull()), "lease-targets")
    return l.once("lease_targets", build)


@rule("lease.orphaned", "leases", "warning", "lease names a missing session or entity", "Release or take over the lease.")
def lease_orphaned(l: Ledger, _t: Thresholds) -> DataFrame:
    return _lease_issue(_lease_sessions(l, "left_anti")).unionByName(_lease_issue(_lease_targets(l).filter(F.col("known").isNull())))


@rule("lease.archived_entity", "leases", "warning", "lease holds an archived entity", "Release the lease.")
def lease_archived(l: Ledger, _t: Thresholds) -> DataFrame:
    return _lease_issue(_lease_targets(l).filter(F.col("gone_at").isNotNull()))


@rule("lease.conflicting_active", "leases", "error", "entity has more than one active lease", "Remove the duplicate leases.")
def lease_conflict(l: Ledger, _t: Thresholds) -> DataFrame:
    groups = _held(l).groupBy("entity_type", "entity_id").agg(F.count("*").alias("count")).filter(F.col("count") > 1)
    key = F.concat_ws(":", "entity_type", "entity_id")
    return groups.select(F.lit("lease").alias("entity_type"), key.alias("entity_id"), details("entity_type", "entity_id", "count"))


# --- privacy, refresh ----------------------------------------------------------------

def secret_matches(df: DataFrame, text: Column) -> DataFrame:
    """Rows of ``df`` with one line per pattern family that matches anywhere in the whole text."""
    hits = F.filter(F.array(*[
        F.struct(F.lit(family).alias("family"), F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0).alias("match"))
        for family, pattern in SECRET_PATTERNS.items()]), lambda h: h["match"] != "")
    return df.withColumn("hit", F.explode(hits)).withColumn("pattern_family", F.col("hit.family")).withColumn(
        "snippet", tx.secret_snippet(F.col("hit.match"))).drop("hit")


def refresh_file_secrets(l: Ledger, _t: Thresholds) -> DataFrame | None:
    """Secret patterns in the files of refresh events, if the ledger comes with ``contents``: (path, content) of whole files."""
    if "contents" not in set(l.tables):
        return None
    rows = secret_matches(refresh_paths(l).join(l.tables["contents"].select("path", "content"), "path"), F.col("content"))
    return found(rows, "refresh_event", "id", "source", "path", "path_column", "pattern_family", "snippet")


@row_rule("privacy.secret_pattern", "privacy", "warning", "text looks like it holds a secret",
          "Remove the secret from the ledger and rotate it.", find=refresh_file_secrets)
def secrets(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    scans = [("jobs", "job", "command"), ("notes", "note", "body"), *[(t, k, "attrs_json") for t, k in ATTR_TABLES.items()]]
    checks = []
    for table, kind, column in scans:
        for family, pattern in SECRET_PATTERNS.items():
            match = F.regexp_extract(F.col(column), pattern, 0)
            checks.append(RowCheck(table, kind, F.col(column).rlike(pattern), details(
                F.lit(column).alias("field"), F.lit(family).alias("pattern_family"), tx.secret_snippet(match).alias("snippet"))))
    return checks


@row_rule("refresh.failed", "refresh", "warning", "refresh did not finish", "Read the debug output and refresh again.")
def refresh_failed(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return [RowCheck("refresh_events", "refresh_event", F.col("status") == "failed", details("source", "stage", "error_message"))]


@row_rule("refresh.manifest_unapplied", "refresh", "warning", "planned refresh was never applied", "Check the manifest and apply it.")
def refresh_unapplied(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return [RowCheck("refresh_events", "refresh_event", (F.col("status") == "dry_run") & (F.col("manifest_path") != ""), details("source", "manifest_path"))]


def refresh_paths(l: Ledger) -> DataFrame:
    cols = ["snapshot_path", "manifest_path", "debug_path"]
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("path_column"), F.col(c).alias("path")) for c in cols]))
    return l.table("refresh_events").select("id", "source", stack.alias("p")).select("id", "source", "p.path_column", "p.path").filter(
        F.nullif("path", F.lit("")).isNotNull())


@rule("refresh.snapshot_missing", "refresh", "warning", "file of a refresh event is gone", "Refresh the source again.")
def refresh_missing(l: Ledger, _t: Thresholds) -> DataFrame:
    return found(refresh_paths(l).join(freshness.observed_files(l).select("path"), "path", "left_anti"), "refresh_event", "id",
                 "source", "path", "path_column")


@rule("refresh.snapshot_stale", "refresh", "warning", "file of a refresh event is old", "Refresh the source if it is still in use.")
def refresh_stale(l: Ledger, t: Thresholds) -> DataFrame:
    cutoff = F.unix_micros(l.ago(24 * t.snapshot_days).cast("timestamp")) / F.lit(1000000.0)
    old = refresh_paths(l).join(freshness.observed_files(l), "path").filter(F.col("observed_mtime") < cutoff)
    return found(old, "refresh_event", "id", "source", "path", "path_column", F.lit(t.snapshot_days).alias("stale_refresh_snapshot_days"))


# --- freshness, runs, edges, schema -----------------------------------------------------

@rule("artifact.local_drift", "artifact.local_drift", "warning", "file differs from its captured state",
      "Capture the file again if the change is wanted.")
def local_drift(l: Ledger, _t: Thresholds) -> DataFrame:
    return found(freshness.drift(l), "artifact", "artifact_id", "uri", "type", "drift_kind")


@rule("validation.source_drift", "validation.source_drift", "warning", "source of a validation changed later",
      "Run the validation again.")
def source_drift(l: Ledger, _t: Thresholds) -> DataFrame:
    return found(freshness.stale_validations(l), "validation", "validation_id", "check_name", "status", "source_artifact_id", "source_drifted",
                 stamp("source_updated_at"))


@rule("experiment.checkpoint_stale", "experiment.checkpoint_stale", "warning", "experiment lacks a current handoff",
      "Write a handoff.")
def checkpoint_stale(l: Ledger, t: Thresholds) -> DataFrame:
    rows = freshness.experiment_freshness(l, t.stale_hours).filter(F.col("deleted_at").isNull() & F.col("handoff_status").isin("missing", "stale"))
    return found(rows, "experiment", "experiment_id", "name", "handoff_status", stamp("last_handoff_at"), "since_last_handoff_hours")


@rule("runs.expected_missing", "runs.expected_missing", "warning", "fewer active runs than expected",
      "Register the missing runs or correct the expectation.")
def expected_missing(l: Ledger, _t: Thresholds) -> DataFrame:
    want = l.active("experiments").select("id", F.floor(attr_number(F.col("attrs_json"), ATTR_EXPECTED_RUNS)).alias("expected_runs")).filter(
        F.col("expected_runs").isNotNull())
    have = l.active("runs").filter(F.col("experiment_id").isNotNull()).groupBy(F.col("experiment_id").alias("id")).agg(F.count("*").alias("n"))
    rows = want.join(have, "id", "left").withColumn("actual_runs", F.coalesce("n", F.lit(0).cast("bigint"))).withColumn(
        "missing_runs", F.col("expected_runs") - F.col("actual_runs")).filter("missing_runs > 0")
    return found(rows, "experiment", "id", "expected_runs", "actual_runs", "missing_runs")


@row_rule("artifact.unlinked_to_run", "artifact.unlinked_to_run", "warning", "run output is not linked to a run",
          "Attach the artifact to its run.")
def unlinked(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return [RowCheck("artifacts", "artifact", F.col("run_id").isNull() & F.col("type").isin("checkpoint", "eval-result"),
                     details("experiment_id", "type", "uri"))]


def _bad_edges(l: Ledger) -> DataFrame:
    """Active run edges that lack an active end, or are open although their job is over; stored once for both rules."""
    def build() -> DataFrame:
        jobs = l.active("jobs").select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
        runs = l.active("runs").select(F.col("id").alias("run_id"), F.lit(True).alias("run_there"))
        edge = l.active("job_runs").select("job_id", "run_id", "role", F.col("status").alias("edge_status"))
        rows = edge.join(jobs, "job_id", "left").join(runs, "run_id", "left").withColumn("orphan", F.col("job_status").isNull() | F.col("run_there").isNull())
        return cut(rows.filter(F.col("orphan") | (F.col("job_status").isin(TERMINAL_JOB_STATUSES) & ~F.col("edge_status").isin(TERMINAL_JOB_STATUSES))), "bad-edges")
    return l.once("bad_edges", build)


@rule("job_runs.stale_state", "job_runs.stale_state", "warning", "job is over but its run edge is not",
      "Update the edge status.")
def edge_stale(l: Ledger, _t: Thresholds) -> DataFrame:
    return found(_bad_edges(l).filter("NOT orphan"), "job_run", F.concat_ws(":", "job_id", "run_id"), "job_id", "run_id", "role", "edge_status", "job_status")


@rule("job_runs.orphan", "job_runs.orphan", "error", "run edge points at a missing or archived job or run",
      "Archive the edge or restore its ends.")
def edge_orphan(l: Ledger, _t: Thresholds) -> DataFrame:
    return found(_bad_edges(l).filter("orphan"), "job_run", F.concat_ws(":", "job_id", "run_id"), "job_id", "run_id")


@row_rule("schema.version_mismatch", "schema-version", "error", "ledger has another schema version than this library",
          "Rewrite the ledger with this library version.")
def schema_version(_l: Ledger, _t: Thresholds) -> list[RowCheck]:
    return [RowCheck("schema_metadata", None, (F.col("key") == "schema_version") & (F.col("value") != str(SCHEMA_VERSION)), details(
        F.col("value").alias("ledger_schema_version"), F.lit(str(SCHEMA_VERSION)).alias("installed_schema_version")))]


# --- runner, scoping, summary ---------------------------------------------------------------

def run_audit(l: Ledger, checks: list[str] | None = None, limits: Thresholds | None = None) -> DataFrame:
    """All issues of the selected checks (default: all)."""
    known = {r.check for r in RULES.values()}
    unknown = sorted(set(checks or []) - known)
    if unknown:
        raise ValueError(f"unknown audit check(s): {', '.join(unknown)}")
    limits = limits or Thresholds()
    picked = [r for r in RULES.values() if not checks or r.check in checks]
    fused = scan_tables(l, [(r, c) for r in picked if r.rows for c in r.rows(l, limits)])
    return union_all(fused + [r.label(df) for r in picked if r.find and (df := r.find(l, limits)) is not None])


def all_issues(l: Ledger) -> DataFrame:
    """Issues of the full audit, materialised once: scoping and reports read them many times."""
    return l.once("issues", lambda: cut(run_audit(l), "issues"))


def scope_issues(l: Ledger, issues: DataFrame) -> DataFrame:
    """Issues with ``owner_id``: one row per experiment an issue concerns; issues of none drop out.

    Issues on leases, notes and validations are first led to their target, so each
    ownership bridge is joined once, and only for the jobs and artifacts an issue leads to.
    """
    cols = [*ISSUE_COLUMNS, "owner_id"]
    named = issues.filter(F.col("entity_id").isNotNull())
    carriers = {"lease": "leases", "note": "notes", "validation": "validations"}
    parts = [named.filter(F.col("entity_type").isin("experiment", "run", "job", "artifact")).withColumn(
        "target_type", F.col("entity_type")).withColumn("target_id", F.col("entity_id"))]
    for kind, table in carriers.items():
        target = l.table(table).select(F.col("id").alias("entity_id"), F.col("entity_type").alias("target_type"),
                                       F.col("entity_id").alias("target_id"))
        parts.append(named.filter(F.col("entity_type") == kind).join(target, "entity_id"))
    led = cut(union_all(parts), "issue-targets")

    def via(df: DataFrame, key: str, bridge: DataFrame, bridge_key: str) -> DataFrame:
        b = bridge.select(F.col(bridge_key).alias("_k"), F.col("experiment_id").alias("owner_id"))
        return df.join(b, F.col(key) == F.col("_k")).select(*cols)

    def of(kind: str) -> DataFrame:
        return led.filter(F.col("target_type") == kind)

    edge = named.filter(F.col("entity_type") == "job_run").withColumn("_job", F.substring_index("entity_id", ":", 1)).withColumn(
        "_run", F.regexp_extract("entity_id", "^[^:]*:(.*)$", 1))
    asked = of("job").select(F.col("target_id").alias("id")).unionByName(edge.select(F.col("_job").alias("id"))).distinct()
    run_map, job_map = run_experiments(l, "audit"), cut(job_experiments(l, "audit", asked), "asked-jobs")
    art_map = artifact_experiments(l, "audit", of("artifact").select(F.col("target_id").alias("artifact_id")))
    both = via(edge, "_job", job_map, "job_id").unionByName(via(edge, "_run", run_map, "run_id")).distinct()
    return union_all([of("experiment").withColumn("owner_id", F.col("target_id")).select(*cols),
                      via(of("run"), "target_id", run_map, "run_id"), via(of("job"), "target_id", job_map, "job_id"),
                      via(of("artifact"), "target_id", art_map, "artifact_id"), both])


def scoped_counts(l: Ledger, issues: DataFrame) -> DataFrame:
    """Per experiment: scoped issues, errors, and how many global issues fall outside its scope."""
    total = issues.agg(F.count("*").alias("global_issue_count"))
    per = scope_issues(l, issues).groupBy(F.col("owner_id").alias("experiment_id")).agg(
        F.count("*").alias("issue_count"), count_if(F.col("severity") == "error").alias("error_count"))
    return per.join(F.broadcast(total)).select(  # the total is a single row
        "experiment_id", "issue_count", "error_count",
        (F.col("error_count") == 0).cast("int").alias("ok"), "global_issue_count",
        F.greatest(F.col("global_issue_count") - F.col("issue_count"), F.lit(0).cast("bigint")).alias("global_omitted_count"))


def audit_summary(issues: DataFrame, strict: bool = False) -> DataFrame:
    """One row: ok (no error) and failed (any error, or any issue when strict)."""
    return issues.agg(F.count("*").alias("issue_count"), F.coalesce(count_if(F.col("severity") == "error"), F.lit(0).cast("bigint")).alias("error_count")).select(
        "issue_count", "error_count", (F.col("error_count") == 0).cast("int").alias("ok"),
        ((F.col("error_count") > 0) | (F.lit(strict) & (F.col("issue_count") > 0))).cast("int").alias("failed"))
