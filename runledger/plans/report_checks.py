"""Report queries with their checking SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from runledger.operators import ownership, reports
from runledger.plans.checking import register
from runledger.schemas import JOB_STATUSES, NOTE_STATUSES, NOTE_TYPES, RUN_KINDS, RUN_PHASES

# list name -> condition on helper recovery
_LISTS = {
    "stale": "status IN ('queued','running') AND updated_at < :as_of - INTERVAL 24 HOUR", "failed": "status = 'failed'",
    "blocking_failed": "retry_state = 'blocking_failed'", "recovery_in_progress": "retry_state = 'recovery_in_progress'",
    "recovered_failed": "retry_state = 'recovered_failed'", "submitting": "status = 'submitting'", "unknown_submit": "status = 'unknown_submit'"}

register("check_rollup", """
 SELECT e.id AS experiment_id, count(v.id) AS total, count(*) FILTER (WHERE v.status = 'fail') AS failed,
  count(*) FILTER (WHERE v.status = 'unknown' AND v.attrs_json LIKE '%"validation.blocking":true%') AS unknown_blocking,
  count(*) FILTER (WHERE v.status = 'warning') AS warnings,
  CASE WHEN bool_or(v.status = 'fail') THEN 'fail' WHEN bool_or(v.status = 'unknown' AND v.attrs_json LIKE '%"validation.blocking":true%') THEN 'unknown'
   WHEN bool_or(v.status = 'warning') THEN 'warning' WHEN count(v.id) > 0 THEN 'pass' ELSE 'none' END AS validation_status
 FROM experiments e LEFT JOIN validations v ON v.entity_type = 'experiment' AND v.entity_id = e.id AND v.deleted_at IS NULL GROUP BY e.id""")
register("job_listing", " UNION ALL ".join(
    f"SELECT experiment_id, '{n}' AS list_name, id AS job_id, name, status, updated_at, row_number() OVER (PARTITION BY experiment_id ORDER BY "
    f"updated_at {'ASC' if n == 'stale' else 'DESC'}, id) AS rank FROM recovery WHERE experiment_id IS NOT NULL AND {c}" for n, c in _LISTS.items()))
_CAP = "(SELECT count(*) FROM job_listing g WHERE g.experiment_id = e.id AND list_name {0})"
register("status_all", "SELECT *, CAST(blocker_count = 0 AND active_job_count = 0 AS INT) AS is_ready, CAST(blocker_count > 0 AS INT) AS has_active_blockers FROM ("
    "SELECT e.id AS experiment_id, e.name, (SELECT count(*) FROM live_links k WHERE k.experiment_id = e.id) AS run_count, "
    + ", ".join(f"coalesce(j.s_{s}, 0) AS jobs_{s}" for s in JOB_STATUSES)
    + ", coalesce(j.s_submitting + j.s_unknown_submit + j.s_queued + j.s_running, 0) AS active_job_count, "
    + f"{_CAP.format(chr(61) + chr(39) + 'blocking_failed' + chr(39))} + r.failed + r.unknown_blocking AS blocker_count, "
    + f"{_CAP.format('= ' + repr('recovery_in_progress'))} AS recovery_in_progress_count, {_CAP.format('= ' + repr('recovered_failed'))} AS recovered_failed_count, "
    + f"{_CAP.format('IN ' + repr(('submitting', 'unknown_submit')))} AS submission_uncertainty_count, r.validation_status, "
    + f"{_CAP.format('= ' + repr('failed'))} AS failed_list_count, {_CAP.format('= ' + repr('stale'))} AS stale_list_count "
    + "FROM experiments e JOIN check_rollup r ON r.experiment_id = e.id LEFT JOIN (SELECT experiment_id, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS s_{s}" for s in JOB_STATUSES) + " FROM live_jobs GROUP BY 1) j ON j.experiment_id = e.id) z")
register("exp_notes", "SELECT *, entity_id AS experiment_id FROM notes WHERE entity_type = 'experiment' AND deleted_at IS NULL")
register("first_lines", r"""
 SELECT id, CASE WHEN length(line) > 200 THEN line[1:199] || '…' ELSE line END AS preview FROM (SELECT id,
  regexp_replace(regexp_extract(body, '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}][^\n\r\x{0b}\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*'), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '') AS line FROM notes) z""")


def _digest(lists: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT experiment_id, '{n}' AS list_name, row_number() OVER (PARTITION BY experiment_id ORDER BY updated_at DESC, id) AS rank, "
        f"id AS note_id, note_type, status, title, body_format, body, updated_at FROM exp_notes WHERE note_type = '{t}'"
        + (f" AND status = '{s}'" if s else "") + ") z" for n, (t, s) in lists.items())


_MARKED = "deleted_at IS NULL AND attrs_json LIKE '%\"ledger.erratum\":true%'"
register("lease_pairs", """SELECT l.*, o.experiment_id FROM leases l JOIN (SELECT * FROM lease_owner WHERE entity_type <> 'experiment'
 UNION ALL SELECT DISTINCT 'experiment', entity_id, entity_id FROM leases WHERE entity_type = 'experiment') o
 ON o.entity_type = l.entity_type AND o.entity_id = l.entity_id""")
register("lease_rollup", """SELECT e.id AS experiment_id, count(p.id) AS active_count,
 count(*) FILTER (WHERE p.heartbeat_at < :as_of - INTERVAL 1 HOUR) AS stale_count, count(*) FILTER (WHERE p.expires_at <= :as_of) AS expired_count
 FROM experiments e LEFT JOIN lease_pairs p ON p.experiment_id = e.id AND p.released_at IS NULL GROUP BY e.id""")
register("situation", """
 SELECT s.*, f.handoff_status, l.stale_count, l.expired_count, coalesce(q.issue_count, 0) AS audit_issue_count, coalesce(q.ok, 1) AS audit_ok,
  (SELECT count(*) FROM exp_notes n WHERE n.experiment_id = s.experiment_id AND note_type = 'handoff' AND status = 'open') AS n_handoff,
  (SELECT count(*) FROM exp_notes n WHERE n.experiment_id = s.experiment_id AND note_type = 'next-action' AND status = 'open') AS n_next,
  (SELECT count(*) FROM exp_notes n WHERE n.experiment_id = s.experiment_id AND note_type = 'debug' AND status = 'open') AS n_debug,
  (SELECT count(*) FROM exp_notes n WHERE n.experiment_id = s.experiment_id AND note_type = 'decision') AS n_decision,
  (SELECT count(*) FROM redacted a WHERE a.experiment_id = s.experiment_id AND a.type = 'metric-table') AS n_table
 FROM status_all s JOIN fresh f USING (experiment_id) JOIN lease_rollup l USING (experiment_id) LEFT JOIN scoped q USING (experiment_id)""")


def _pick(pairs: dict[str, str], fallback: str) -> str:
    arms = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in pairs.items())
    hits = f"list_filter([{arms}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({hits}) = 0 THEN ['{fallback}'] ELSE {hits} END"


_TRIAGE = _pick({"Inspect failed jobs and note the recovery path.": "failed_list_count > 0", "Refresh stale queued or running jobs.": "stale_list_count > 0",
                 "Resolve or update open debug notes.": "n_debug > 0", "Run the audit and work through its issues.": "audit_issue_count > 0"},
                "Nothing urgent; go on with the next planned step.")
_LOOP = _pick({"refresh_external_state": "active_job_count > 0", "inspect_issues": "audit_issue_count > 0", "write_handoff": "handoff_status IN ('missing','stale')",
               "resolve_leases": "stale_count + expired_count > 0"}, "continue")
_CLOSE = [("audit", "audit_ok = 1", "audit_issue_count", "issue(s)"), ("failed_jobs", "failed_list_count = 0", "failed_list_count", "failed job(s)"),
          ("stale_jobs", "stale_list_count = 0", "stale_list_count", "stale job(s)"),
          ("unresolved_notes", "n_handoff + n_next + n_debug = 0", "n_handoff + n_next + n_debug", "open note(s)"),
          ("metric_table_export", "n_table > 0", "n_table", "metric-table artifact(s)"), ("decision_note", "n_decision > 0", "n_decision", "decision note(s)")]
_READY = "CAST(" + " AND ".join(f"({c})" for _i, c, _n, _t in _CLOSE) + " AS INT)"


def _many(n: str, noun: str) -> str:
    return f"({n}) || ' {noun}' || CASE WHEN ({n}) = 1 THEN '' ELSE 's' END"


_OPEN_NOTES = "(SELECT count(*) FROM exp_notes n WHERE n.experiment_id = x.experiment_id AND status = 'open' AND note_type IN ('handoff','next-action','debug'))"
_ACTIONS = [
    ("refresh-external-state", "active_job_count > 0", _many("active_job_count", "active job")),
    ("resolve-failed-jobs", "blocking_failed_job_count + recovery_in_progress_failed_job_count > 0",
     _many("blocking_failed_job_count", "blocking failed job") + " || ', ' || " + _many("recovery_in_progress_failed_job_count", "recovering failure")),
    ("fix-failing-validations", "failing_validation_count > 0", _many("failing_validation_count", "failing validation")),
    ("write-handoff", "handoff_status IN ('missing','stale')", "'handoff is ' || handoff_status"),
    ("resolve-stale-leases", "stale_lease_count > 0", _many("stale_lease_count", "stale lease")),
    ("review-open-notes", f"{_OPEN_NOTES} > 0", _many(_OPEN_NOTES, "open action note")),
    ("review-outputs", "lifecycle_state = 'review'", "'unreviewed activity at ' || strftime(last_reviewable_activity_at, '%Y-%m-%dT%H:%M:%SZ')")]

_CLEAN = """SELECT experiment_id, 'debug_note' AS plan, row_number() OVER (PARTITION BY r.experiment_id ORDER BY n.updated_at DESC, n.id) AS rank, n.id AS entity_id,
  coalesce(n.title, p.preview) AS label FROM notes n JOIN recovery r ON r.id = n.entity_id AND r.retry_state = 'recovered_failed' JOIN first_lines p ON p.id = n.id
  WHERE n.entity_type = 'job' AND n.note_type = 'debug' AND n.status = 'open' AND n.deleted_at IS NULL AND r.experiment_id IS NOT NULL
 UNION ALL SELECT entity_id, 'superseded_validation', row_number() OVER (PARTITION BY entity_id ORDER BY check_name, updated_at DESC, id DESC), id, check_name
  FROM validations v WHERE deleted_at IS NULL AND entity_type = 'experiment' AND status <> 'pass' AND EXISTS (FROM validations p WHERE p.deleted_at IS NULL
  AND p.entity_type = 'experiment' AND p.entity_id = v.entity_id AND p.check_name = v.check_name AND p.status = 'pass' AND p.updated_at >= v.updated_at)"""
register("cleanup", _CLEAN)


def _refs(l):
    names = l.table("runs").select(F.col("name").alias("ref"))
    ids = l.table("runs").select(F.col("id").alias("ref"))
    odd = l.table("runs").select(F.concat(F.col("id"), F.lit("x")).alias("ref"))
    return reports.resolve_refs(l, "runs", names.unionByName(ids).unionByName(odd))


def _entity(variant):
    return lambda l: ownership.entity_experiments(l, variant)


_D1, _D2 = datetime(2001, 11, 20), datetime(2001, 11, 25)
_CLEANED_NOTES = ("SELECT id, status, updated_at, resolved_at, deleted_at FROM (SELECT n.* REPLACE (CASE WHEN c.entity_id IS NULL THEN n.status ELSE 'resolved' END AS status, "
    "CASE WHEN c.entity_id IS NULL THEN n.updated_at ELSE :as_of END AS updated_at, CASE WHEN c.entity_id IS NULL THEN n.resolved_at ELSE :as_of END AS resolved_at) "
    "FROM notes n LEFT JOIN (SELECT DISTINCT entity_id FROM cleanup WHERE plan = 'debug_note' AND experiment_id IN (SELECT id FROM experiments WHERE deleted_at IS NULL)) c ON c.entity_id = n.id) z")


REPORTS = {
    "experiment_status": (reports.experiment_status, "SELECT * FROM status_all"),
    "status_job_lists": (reports.status_job_lists, "SELECT experiment_id, list_name, rank, job_id, name, status, updated_at FROM job_listing"),
    "run_progress_summary": (reports.run_progress_summary, "SELECT *, CASE WHEN expected IS NOT NULL THEN greatest(expected - total, 0) END AS missing_expected_count FROM ("
        "SELECT e.id AS experiment_id, count(p.run_id) AS total, any_value(CAST(CASE WHEN e.attrs_json LIKE '{%' THEN json_extract_string(e.attrs_json, '$.\"progress.expected_runs\"') END AS BIGINT)) AS expected, "
        + ", ".join(f"count(*) FILTER (WHERE p.kind = '{k}') AS kind_{k}" for k in RUN_KINDS) + ", " + ", ".join(f"count(*) FILTER (WHERE p.phase = '{k}') AS phase_{k}" for k in RUN_PHASES)
        + ", count(*) FILTER (WHERE has_checkpoint = 1) AS with_checkpoint, count(*) FILTER (WHERE has_eval_result = 1) AS with_eval_result "
          "FROM experiments e LEFT JOIN progress p ON p.experiment_id = e.id GROUP BY e.id) z"),
    "run_progress_by_metric": (reports.run_progress_by_metric, "SELECT r.experiment_id, metric_name, count(DISTINCT r.id) AS run_count FROM runs r JOIN metrics m ON m.run_id = r.id "
        "WHERE r.deleted_at IS NULL AND m.deleted_at IS NULL AND r.experiment_id IS NOT NULL GROUP BY ALL"),
    "run_progress_failed_examples": (reports.run_progress_failed_examples, "SELECT experiment_id, rank, run_id, name FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id "
        "ORDER BY name, run_id) AS rank FROM progress WHERE phase = 'failed') z"),
    "note_counts": (reports.note_counts, f"SELECT e.id AS experiment_id, t AS note_type, s AS status, (SELECT count(*) FROM exp_notes n WHERE n.experiment_id = e.id AND n.note_type = t AND n.status = s) AS note_count "
        f"FROM experiments e CROSS JOIN unnest({NOTE_TYPES}) AS a(t) CROSS JOIN unnest({NOTE_STATUSES}) AS b(s)"),
    "note_digest": (reports.note_digest, f"SELECT d.* EXCLUDE (body), p.preview AS body_preview FROM ({_digest(reports.STATUS_NOTES)}) d JOIN first_lines p ON p.id = d.note_id"),
    "note_context": (reports.note_context, _digest(reports.CONTEXT_NOTES)),
    "validation_summary": (reports.validation_summary, "SELECT * FROM check_rollup"),
    "experiment_artifacts": (reports.experiment_artifacts, "SELECT o.experiment_id, row_number() OVER (PARTITION BY o.experiment_id ORDER BY updated_at DESC, id) AS rank, id AS artifact_id, type, uri, updated_at "
        "FROM artifacts a JOIN artifact_owner o ON o.artifact_id = a.id WHERE a.deleted_at IS NULL"),
    "errata_log": (reports.errata_log, f"""SELECT o.experiment_id, k.kind AS entity_type, k.id AS entity_id, k.created_at FROM (
        SELECT 'note' AS kind, id, created_at, entity_type AS tt, entity_id AS ti FROM notes WHERE {_MARKED} UNION ALL SELECT 'artifact', id, created_at, 'artifact', id FROM artifacts WHERE {_MARKED}
        UNION ALL SELECT 'validation', id, created_at, entity_type, entity_id FROM validations WHERE {_MARKED}) k
        JOIN owner_all o ON o.entity_type = k.tt AND o.entity_id = k.ti"""),
    "lease_summary": (reports.lease_summary, "SELECT * FROM lease_rollup"),
    "lease_lists": (reports.lease_lists, """SELECT experiment_id, list_name, row_number() OVER (PARTITION BY experiment_id, list_name ORDER BY t_at DESC, id) AS rank, id AS lease_id, entity_type, entity_id, owner_agent,
        heartbeat_at, expires_at FROM (SELECT 'active' AS list_name, heartbeat_at AS t_at, * FROM lease_pairs WHERE released_at IS NULL
        UNION ALL SELECT 'stale', heartbeat_at, * FROM lease_pairs WHERE released_at IS NULL AND heartbeat_at < :as_of - INTERVAL 1 HOUR
        UNION ALL SELECT 'expired', heartbeat_at, * FROM lease_pairs WHERE released_at IS NULL AND expires_at <= :as_of
        UNION ALL SELECT 'force_takeovers', released_at, * FROM lease_pairs WHERE release_reason = 'force_takeover') z"""),
    "entity_experiments_owner": (_entity("owner"), "SELECT * FROM owner_all"),
    "entity_experiments_lease": (_entity("lease"), "SELECT * FROM lease_owner"),
    "entity_experiments_audit": (_entity("audit"), "SELECT * FROM audit_owner"),
    "triage": (reports.triage, f"SELECT experiment_id, failed_list_count AS failed_job_count, stale_list_count AS stale_job_count, n_debug AS open_debug_count, audit_ok, audit_issue_count, "
        f"CAST(to_json({_TRIAGE}) AS VARCHAR) AS suggested_next_actions FROM situation"),
    "triage_artifacts": (reports.triage_artifacts, "SELECT experiment_id, row_number() OVER (PARTITION BY experiment_id ORDER BY updated_at DESC, artifact_id DESC) AS rank, artifact_id, type, uri_locality, display_uri, "
        "updated_at FROM redacted WHERE experiment_id IS NOT NULL"),
    "closeout_checklist": (reports.closeout_checklist, " UNION ALL ".join(
        f"SELECT experiment_id, {_READY} AS ready, '{i}' AS item_id, CAST({c} AS INT) AS ok, ({n}) || ' {t}' AS detail FROM situation" for i, c, n, t in _CLOSE)),
    "workloop_actions": (reports.workloop_actions, f"SELECT experiment_id, CAST(k - 1 AS INT) AS position, acts[k] AS action FROM (SELECT experiment_id, {_LOOP} AS acts FROM situation) z, unnest(range(1, len(acts) + 1)) AS u(k)"),
    "recommended_actions": (reports.recommended_actions, " UNION ALL ".join(f"SELECT experiment_id, '{i}' AS action_id, {t} AS issue_summary FROM lifecycle_all x WHERE {c}" for i, c, t in _ACTIONS)),
    "cleanup_plan": (reports.cleanup_plan, "SELECT * FROM cleanup"),
    "apply_cleanup": (lambda l: reports.apply_cleanup(l)["notes"].filter("title IS NULL OR title <> 'Experiment cleanup'").select("id", "status", "updated_at", "resolved_at", "deleted_at"), _CLEANED_NOTES),
    "write_handoffs": (lambda l: reports.write_handoffs(l)["notes"].select("entity_type", "entity_id", "note_type", "status", "title", "body", "created_at", "deleted_at"), """
        SELECT entity_type, entity_id, note_type, status, title, body, created_at, deleted_at FROM notes UNION ALL SELECT 'experiment', experiment_id, 'checkpoint', 'open', 'Experiment handoff',
        '# Experiment Handoff' || chr(10) || chr(10) || '## Freshness' || chr(10) || chr(10) || '- Handoff status: `' || handoff_status || '`' || chr(10) || '- Drifted artifacts: ' || drifted_artifact_count
        || chr(10) || '- Stale validations: ' || stale_validation_count || chr(10), :as_of, NULL FROM fresh WHERE deleted_at IS NULL"""),
    "handoff_examples": (reports.handoff_examples, """SELECT experiment_id, section, row_number() OVER (PARTITION BY experiment_id, section ORDER BY updated_at DESC, entity_id) AS rank, entity_id, label FROM (
        SELECT o.experiment_id, 'drifted_artifact' AS section, d.artifact_id AS entity_id, a.uri || ' (' || d.drift_kind || ')' AS label, a.updated_at
        FROM drift d JOIN artifacts a ON a.id = d.artifact_id JOIN artifact_owner o ON o.artifact_id = a.id
        UNION ALL SELECT c.entity_id, 'stale_validation', c.validation_id, c.check_name, v.updated_at FROM stale_checks_own c JOIN validations v ON v.id = c.validation_id) z"""),
    "archive_experiments": (lambda l: reports.archive_experiments(l, l.table("experiments").filter(F.col("description") == "BUILDING")),
        "SELECT * REPLACE (CASE WHEN description = 'BUILDING' THEN 'archived' ELSE status END AS status, CASE WHEN description = 'BUILDING' THEN coalesce(deleted_at, :as_of) ELSE deleted_at END AS deleted_at, "
        "CASE WHEN description = 'BUILDING' THEN :as_of ELSE updated_at END AS updated_at) FROM experiments"),
    "mark_reviewed": (lambda l: reports.mark_reviewed(l).select("entity_id", "note_type", "status", "attrs_json"),
        """SELECT experiment_id AS entity_id, 'review' AS note_type, 'resolved' AS status, '{"ledger.review":true,"ledger.reviewed_activity_count":' || reviewable_activity_count ||
        ',"ledger.reviewed_activity_key":' || coalesce('"' || strftime(last_reviewable_activity_at, '%Y-%m-%dT%H:%M:%SZ') || ' ' || last_reviewable_activity_id || '"', 'null') ||
        ',"ledger.reviewed_at":"2001-12-01T00:00:00Z"}' AS attrs_json FROM lifecycle_all WHERE deleted_at IS NULL"""),
    "list_experiments": (lambda l: reports.list_experiments(l, tag=" Building "), "SELECT * FROM experiments WHERE deleted_at IS NULL AND id IN (SELECT experiment_id FROM experiment_tags WHERE tag = 'building')"),
    "list_runs": (lambda l: reports.list_runs(l, experiment_id="exp_7"), "SELECT * FROM runs WHERE deleted_at IS NULL AND id IN (SELECT run_id FROM experiment_runs WHERE experiment_id = 'exp_7')"),
    "list_jobs": (lambda l: reports.list_jobs(l, status="failed", include_archived=True), "SELECT * FROM jobs WHERE status = 'failed'"),
    "list_artifacts": (lambda l: reports.list_artifacts(l, experiment_id="exp_7"), "SELECT * FROM artifacts WHERE deleted_at IS NULL AND id IN (SELECT artifact_id FROM artifact_owner WHERE experiment_id = 'exp_7')"),
    "list_metrics": (lambda l: reports.list_metrics(l, metric_name="eval/m1"), "SELECT * FROM metrics WHERE deleted_at IS NULL AND metric_name = 'eval/m1'"),
    "list_notes": (lambda l: reports.list_notes(l, entity_type="experiment", status="open"), "SELECT * FROM notes WHERE deleted_at IS NULL AND entity_type = 'experiment' AND status = 'open'"),
    "list_validations": (lambda l: reports.list_validations(l, status="warning"), "SELECT * FROM validations WHERE deleted_at IS NULL AND status = 'warning'"),
    "list_sessions": (lambda l: reports.list_sessions(l, agent="codex", open_only=True), "SELECT * FROM sessions WHERE agent = 'codex' AND ended_at IS NULL"),
    "list_leases": (lambda l: reports.list_leases(l, entity_type="experiment"), "SELECT * FROM leases WHERE entity_type = 'experiment' AND released_at IS NULL"),
    "reconcile_log": (lambda l: reports.reconcile_log(l, since=_D1, before=_D2), "SELECT * FROM reconcile_events WHERE created_at >= TIMESTAMP '2001-11-20 00:00:00' AND created_at < TIMESTAMP '2001-11-25 00:00:00'"),
    "refresh_log": (lambda l: reports.refresh_log(l, status="failed"), "SELECT id AS refresh_event_id, * EXCLUDE (id) FROM refresh_events WHERE status = 'failed'"),
    "writeback_log": (lambda l: reports.writeback_log(l, target_system="wandb", status="synced"), "SELECT * FROM sync_events WHERE target_system = 'wandb' AND status = 'synced' AND origin = 'writeback'"),
    "resolve_refs": (_refs, """SELECT f.ref, coalesce(d.id, CASE WHEN n.c = 1 THEN n.lo END) AS id, CASE WHEN d.id IS NOT NULL OR n.c = 1 THEN 'ok' WHEN n.c > 1 THEN 'ambiguous' ELSE 'missing' END AS status
        FROM (SELECT name AS ref FROM runs UNION SELECT id FROM runs UNION SELECT id || 'x' FROM runs) f LEFT JOIN runs d ON d.id = f.ref
        LEFT JOIN (SELECT name, count(*) AS c, min(id) AS lo FROM runs WHERE deleted_at IS NULL GROUP BY name) n ON n.name = f.ref"""),
}
