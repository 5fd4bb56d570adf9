"""View queries with their checking SQL, written independently of the Spark plans."""

from __future__ import annotations

from runledger.operators import lifecycle, views
from runledger.plans.checking import register

_ACTIVE = "('submitting','unknown_submit','queued','running')"

register("lifecycle_jobs", """
 SELECT DISTINCT o.experiment_id, r.id, r.status, r.updated_at, r.finished_at, r.retry_state
 FROM recovery r JOIN job_owner o ON o.job_id = r.id""")
register("lifecycle_activity", """
 SELECT experiment_id, coalesce(finished_at, updated_at) AS t_at, id FROM lifecycle_jobs WHERE status IN ('succeeded','failed','killed','skipped')
 UNION ALL SELECT experiment_id, updated_at, id FROM lifecycle_jobs WHERE retry_state = 'recovered_failed'
 UNION ALL SELECT experiment_id, updated_at, id FROM artifacts WHERE deleted_at IS NULL AND experiment_id IS NOT NULL
 UNION ALL SELECT entity_id, updated_at, id FROM validations WHERE deleted_at IS NULL AND entity_type = 'experiment'
 UNION ALL SELECT entity_id, updated_at, id FROM notes WHERE deleted_at IS NULL AND entity_type = 'experiment'
   AND status <> 'superseded' AND note_type IN ('next-action','debug','research','decision')""")
register("lifecycle_base", f"""
 SELECT e.id AS experiment_id, e.name, e.status, e.created_at, e.updated_at, e.deleted_at,
  (SELECT count(*) FROM live_links x WHERE x.experiment_id = e.id) AS run_count,
  coalesce(j.n, 0) AS job_count, coalesce(j.f, 0) AS failed_job_count, coalesce(j.b, 0) AS blocking_failed_job_count,
  coalesce(j.p, 0) AS recovery_in_progress_failed_job_count, coalesce(j.r, 0) AS recovered_failed_job_count,
  coalesce(j.a, 0) AS active_job_count, coalesce(j.u, 0) AS submission_uncertainty_count, coalesce(j.s, 0) AS stale_submission_count,
  (SELECT count(*) FROM validations v WHERE v.entity_type = 'experiment' AND v.entity_id = e.id AND v.deleted_at IS NULL) AS validation_count,
  (SELECT count(*) FROM validations v WHERE v.entity_type = 'experiment' AND v.entity_id = e.id AND v.deleted_at IS NULL AND v.status = 'fail') AS failing_validation_count,
  (SELECT count(*) FROM leases x WHERE x.entity_type = 'experiment' AND x.entity_id = e.id AND x.released_at IS NULL) AS active_lease_count,
  (SELECT count(*) FROM leases x WHERE x.entity_type = 'experiment' AND x.entity_id = e.id AND x.released_at IS NULL
     AND x.heartbeat_at < :as_of - INTERVAL 1 HOUR) AS stale_lease_count,
  (SELECT count(*) FROM artifacts a WHERE a.experiment_id = e.id AND a.deleted_at IS NULL) AS artifact_count,
  (SELECT count(*) FROM notes n WHERE n.entity_type = 'experiment' AND n.entity_id = e.id AND n.deleted_at IS NULL
     AND n.note_type NOT IN ('checkpoint','review')) AS non_handoff_note_count,
  (SELECT max(n.created_at) FROM notes n WHERE n.entity_type = 'experiment' AND n.entity_id = e.id AND n.deleted_at IS NULL
     AND n.note_type = 'checkpoint') AS last_handoff_at,
  rv.t_at AS last_reviewed_at, rv.id AS review_id, rv.cnt AS reviewed_activity_count, coalesce(act.n, 0) AS reviewable_activity_count,
  act.t_at AS last_reviewable_activity_at, act.id AS last_reviewable_activity_id
 FROM experiments e
 LEFT JOIN (SELECT experiment_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f,
   count(*) FILTER (WHERE retry_state = 'blocking_failed') AS b, count(*) FILTER (WHERE retry_state = 'recovery_in_progress') AS p,
   count(*) FILTER (WHERE retry_state = 'recovered_failed') AS r, count(*) FILTER (WHERE status IN {_ACTIVE}) AS a,
   count(*) FILTER (WHERE status IN ('submitting','unknown_submit')) AS u,
   count(*) FILTER (WHERE status IN ('submitting','unknown_submit') AND updated_at < :as_of - INTERVAL 1 HOUR) AS s
   FROM lifecycle_jobs GROUP BY experiment_id) j ON j.experiment_id = e.id
 LEFT JOIN (SELECT entity_id, created_at AS t_at, id, CAST(json_extract_string(attrs_json, '$."ledger.reviewed_activity_count"') AS BIGINT) AS cnt
   FROM notes WHERE entity_type = 'experiment' AND note_type = 'review' AND deleted_at IS NULL
   QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) = 1) rv ON rv.entity_id = e.id
 LEFT JOIN (SELECT experiment_id, t_at, id, n FROM (SELECT experiment_id, t_at, id, count(*) OVER (PARTITION BY experiment_id) AS n,
   row_number() OVER (PARTITION BY experiment_id ORDER BY t_at DESC, id DESC) AS k FROM lifecycle_activity) z WHERE k = 1) act
   ON act.experiment_id = e.id""")
register("lifecycle_all", """
 SELECT * EXCLUDE (review_id), last_handoff_at AS last_checkpoint_at,
  CASE WHEN deleted_at IS NOT NULL OR status = 'archived' THEN 'archived'
   WHEN blocking_failed_job_count + failing_validation_count + stale_lease_count + stale_submission_count > 0 THEN 'needs_attention'
   WHEN active_job_count > 0 THEN 'running' WHEN has_pending_review = 1 THEN 'review' ELSE 'open' END AS lifecycle_state
 FROM (SELECT *, CASE WHEN last_reviewable_activity_at IS NOT NULL AND (last_reviewed_at IS NULL
    OR last_reviewable_activity_at > last_reviewed_at
    OR (last_reviewable_activity_at = last_reviewed_at AND last_reviewable_activity_id > review_id)
    OR reviewable_activity_count > coalesce(reviewed_activity_count, -1)) THEN 1 ELSE 0 END AS has_pending_review,
   CASE WHEN last_handoff_at IS NULL THEN CASE WHEN run_count = 0 AND job_count = 0 AND validation_count = 0 AND artifact_count = 0
     AND non_handoff_note_count = 0 THEN 'idle' ELSE 'missing' END
    WHEN last_handoff_at < :as_of - INTERVAL 24 HOUR THEN 'stale' ELSE 'current' END AS handoff_status
  FROM lifecycle_base) s""")

register("progress_all", """
 SELECT r.experiment_id, r.id AS run_id, r.name, r.kind, r.status,
  CASE WHEN EXISTS (FROM artifacts a WHERE a.run_id = r.id AND a.type = 'checkpoint' AND a.deleted_at IS NULL) THEN 1 ELSE 0 END AS has_checkpoint,
  CASE WHEN EXISTS (FROM artifacts a WHERE a.run_id = r.id AND a.type = 'eval-result' AND a.deleted_at IS NULL) THEN 1 ELSE 0 END AS has_eval_result,
  (SELECT count(DISTINCT m.metric_name) FROM metrics m WHERE m.run_id = r.id AND m.deleted_at IS NULL) AS metric_count,
  g.ta AS train_active_count, g.ts AS train_succeeded_count, g.es AS eval_succeeded_count, g.f AS failed_count,
  g.sk AS skipped_count, g.n AS job_edge_count, g.tf, g.ef, g.xf,
  CASE WHEN e.attrs_json LIKE '%"progress.required_metrics":%' THEN json_array_length(e.attrs_json, '$."progress.required_metrics"') ELSE 0 END AS req
 FROM runs r LEFT JOIN experiments e ON e.id = r.experiment_id
 LEFT JOIN (SELECT r2.id, count(x.run_id) AS n,
   count(*) FILTER (WHERE role = 'train' AND x.status IN ('submitting','queued','running')) AS ta,
   count(*) FILTER (WHERE role = 'train' AND x.status = 'succeeded') AS ts, count(*) FILTER (WHERE role = 'eval' AND x.status = 'succeeded') AS es,
   count(*) FILTER (WHERE x.status IN ('failed','killed')) AS f, count(*) FILTER (WHERE x.status = 'skipped') AS sk,
   count(*) FILTER (WHERE role = 'train' AND x.status IN ('failed','killed')) AS tf,
   count(*) FILTER (WHERE role = 'eval' AND x.status IN ('failed','killed')) AS ef,
   count(*) FILTER (WHERE role NOT IN ('train','eval') AND x.status IN ('failed','killed')) AS xf
   FROM runs r2 LEFT JOIN (SELECT run_id, role, status FROM job_runs WHERE deleted_at IS NULL AND job_id IN (SELECT id FROM live_jobs)) x
   ON x.run_id = r2.id GROUP BY r2.id) g ON g.id = r.id WHERE r.deleted_at IS NULL""")
register("progress", """
 SELECT * EXCLUDE (tf, ef, xf, req), CASE
  WHEN (req > 0 AND metric_count >= req) OR (req = 0 AND (eval_succeeded_count > 0 OR has_eval_result = 1)) THEN 'complete'
  WHEN train_active_count > 0 THEN 'training'
  WHEN (tf > 0 AND train_succeeded_count = 0) OR (ef > 0 AND eval_succeeded_count = 0) OR xf > 0 THEN 'failed'
  WHEN skipped_count > 0 THEN 'skipped' WHEN train_succeeded_count > 0 OR has_checkpoint = 1 THEN 'trained'
  WHEN eval_succeeded_count > 0 OR has_eval_result = 1 THEN 'evaluated' WHEN job_edge_count > 0 THEN 'submitted' ELSE 'planned' END AS phase
 FROM progress_all""")
register("recovery_view", """
 SELECT id AS job_id, experiment_id, run_id, name, status, command, launcher, retry_of, external_system, external_id, failure_reason,
  code_commit, code_dirty, created_at, updated_at, started_at, finished_at, deleted_at, attrs_json,
  CAST(success_id IS NOT NULL AS INT) AS has_success_descendant, CAST(active_id IS NOT NULL AS INT) AS has_active_descendant,
  success_id AS success_descendant_id, active_id AS active_descendant_id, retry_state,
  CAST(coalesce(retry_state = 'blocking_failed', false) AS INT) AS is_blocking_failed,
  CAST(coalesce(retry_state = 'recovery_in_progress', false) AS INT) AS is_recovery_in_progress,
  CAST(coalesce(retry_state = 'recovered_failed', false) AS INT) AS is_recovered_failed,
  CAST(status IN ('submitting','unknown_submit') AS INT) AS is_submission_uncertain FROM recovery""")
register("redacted", """
 SELECT a.id AS artifact_id, (SELECT min(o.experiment_id) FROM artifact_owner o WHERE o.artifact_id = a.id) AS experiment_id, run_id, job_id, type,
  loc AS uri_locality, CASE WHEN loc = 'local-fs' THEN 'local:' || a.id || '/' ||
    CASE WHEN coalesce(base, '') = '' THEN 'artifact' ELSE base END ELSE uri END AS display_uri, content_hash, created_at, updated_at, attrs_json
 FROM (SELECT *, CASE WHEN uri ILIKE 'gs://%' THEN 'gcs' WHEN uri ILIKE 's3://%' THEN 's3' WHEN uri ILIKE 'wandb:%' THEN 'wandb'
   WHEN regexp_matches(uri, '(?i)^https?://') THEN 'http' WHEN uri ILIKE 'file://%' THEN 'local-fs' WHEN contains(uri, '://') THEN 'other'
   ELSE 'local-fs' END AS loc,
   regexp_extract(replace(regexp_replace(uri, '(?i)^file://', ''), chr(92), '/'), '([^/]*)/?$', 1) AS base
  FROM artifacts WHERE deleted_at IS NULL) a""")

_OWN = """SELECT x.id AS {k}_id, l.id AS lease_id, l.owner_agent, l.session_id, l.heartbeat_at, l.expires_at{extra},
 CASE WHEN l.heartbeat_at < :as_of - INTERVAL 1 HOUR THEN 1 ELSE 0 END AS is_stale, CASE WHEN l.expires_at <= :as_of THEN 1 ELSE 0 END AS is_expired
 FROM {t} x LEFT JOIN (SELECT * FROM leases WHERE released_at IS NULL AND entity_type = '{k}') l ON l.entity_id = x.id {join} WHERE x.deleted_at IS NULL"""
register("depth_walk", """SELECT id, 0 AS depth FROM jobs WHERE retry_of IS NULL
 UNION ALL SELECT j.id, w.depth + 1 FROM depth_walk w JOIN jobs j ON j.retry_of = w.id""")

VIEWS = {
    "v_artifacts": (views.artifacts, "SELECT id AS artifact_id, experiment_id, run_id, job_id, type, uri, content_hash, created_at, updated_at, attrs_json FROM artifacts WHERE deleted_at IS NULL"),
    "v_notes": (views.notes, "SELECT id AS note_id, * EXCLUDE (id, resolved_at, deleted_at) FROM notes WHERE deleted_at IS NULL"),
    "v_sync_events": (views.sync_events, "SELECT id AS sync_event_id, * EXCLUDE (id) FROM sync_events"),
    "v_experiments": (views.experiments, """SELECT id AS experiment_id, name, description, status, idempotency_key, created_at, updated_at, attrs_json,
        coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM experiment_tags t WHERE t.experiment_id = e.id), '') AS tags
        FROM experiments e WHERE deleted_at IS NULL"""),
    "v_runs": (views.runs, """SELECT id, id AS run_id, * EXCLUDE (id, deleted_at), coalesce((SELECT string_agg(k.experiment_id, ',' ORDER BY k.experiment_id)
        FROM experiment_runs k WHERE k.run_id = r.id AND k.experiment_id IN (SELECT id FROM experiments WHERE deleted_at IS NULL)), '') AS experiment_ids
        FROM runs r WHERE deleted_at IS NULL"""),
    "v_jobs": (views.jobs, "SELECT id, id AS job_id, * EXCLUDE (id, deleted_at) FROM jobs WHERE deleted_at IS NULL"),
    "v_job_runs": (views.job_runs, """SELECT k.job_id, k.run_id, r.experiment_id, k.role, k.status, k.started_at, k.finished_at, k.failure_reason,
        k.created_at, k.updated_at, k.attrs_json FROM job_runs k, runs r WHERE r.id = k.run_id AND r.deleted_at IS NULL AND k.deleted_at IS NULL
        AND EXISTS (FROM live_jobs j WHERE j.id = k.job_id)"""),
    "v_validations": (views.validations, "SELECT id AS validation_id, * EXCLUDE (id, deleted_at) FROM validations WHERE deleted_at IS NULL"),
    "v_sessions": (views.sessions, "SELECT id AS session_id, * EXCLUDE (id) FROM sessions"),
    "v_experiment_session_history": (views.experiment_session_history, """SELECT experiment_id, id AS session_id, ledger_id, agent, cwd, git_branch, git_commit,
        intent, started_at, last_touch_at, ended_at, attrs_json FROM sessions WHERE experiment_id IS NOT NULL"""),
    "v_refresh_log": (views.refresh_log, "SELECT id AS refresh_event_id, * EXCLUDE (id) FROM refresh_events"),
    "v_lease_history": (views.lease_history, "SELECT id AS lease_id, * EXCLUDE (id) FROM leases"),
    "v_dashboard_runs": (views.dashboard_runs, "SELECT * FROM progress"),
    "v_dashboard_jobs": (views.dashboard_jobs, "SELECT * FROM recovery_view"),
    "v_dashboard_validations": (views.dashboard_validations, """SELECT entity_id AS experiment_id, id AS validation_id, check_name, status, expected_value,
        measured_value, updated_at FROM validations WHERE deleted_at IS NULL AND entity_type = 'experiment'"""),
    "v_dashboard_notes": (views.dashboard_notes, """SELECT entity_id AS experiment_id, id AS note_id, note_type, status, title, body[1:240] AS body_preview,
        updated_at FROM notes WHERE deleted_at IS NULL AND entity_type = 'experiment'"""),
    "v_dashboard_artifacts": (views.dashboard_artifacts, """SELECT experiment_id, id AS artifact_id, type AS artifact_type, uri, CAST(NULL AS VARCHAR) AS external_system,
        CAST(NULL AS VARCHAR) AS external_id, updated_at FROM artifacts WHERE deleted_at IS NULL AND experiment_id IS NOT NULL"""),
    "v_metrics_long": (views.metrics_long, """SELECT k.experiment_id, r.id AS run_id, r.name AS run_name, m.id AS metric_id, m.metric_name, m.value, m.step, m.split,
        m.source_job_id, m.source_artifact_id, m.updated_at FROM metrics m JOIN runs r ON m.run_id = r.id AND r.deleted_at IS NULL
        JOIN experiment_runs k USING (run_id) WHERE m.deleted_at IS NULL"""),
    "v_experiment_summary": (views.experiment_summary, """SELECT e.id AS experiment_id, e.name, e.status, e.updated_at,
        (SELECT count(*) FROM live_links k WHERE k.experiment_id = e.id) AS run_count,
        coalesce(j.n, 0) AS job_count, coalesce(j.f, 0) AS failed_job_count, coalesce(j.r, 0) AS running_job_count,
        (SELECT count(*) FROM artifact_owner o JOIN artifacts a ON a.id = o.artifact_id AND a.deleted_at IS NULL WHERE o.experiment_id = e.id) AS artifact_count,
        (SELECT count(*) FROM metrics m JOIN experiment_runs k USING (run_id) WHERE k.experiment_id = e.id AND m.deleted_at IS NULL) AS metric_count,
        (SELECT count(*) FROM notes n WHERE n.entity_type = 'experiment' AND n.entity_id = e.id AND n.status = 'open' AND n.deleted_at IS NULL) AS open_note_count
        FROM experiments e LEFT JOIN (SELECT o.experiment_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f,
        count(*) FILTER (WHERE status = 'running') AS r FROM job_owner o JOIN live_jobs ON live_jobs.id = o.job_id GROUP BY ALL) j ON j.experiment_id = e.id
        WHERE e.deleted_at IS NULL"""),
    "v_run_summary": (views.run_summary, """SELECT r.id AS run_id, r.experiment_id, r.name, r.status, r.kind, r.idempotency_key, r.parent_run_id, r.updated_at,
        coalesce((SELECT string_agg(DISTINCT k.experiment_id, ',' ORDER BY k.experiment_id) FROM experiment_runs k WHERE k.run_id = r.id), '') AS experiment_ids,
        (SELECT count(*) FROM job_runs x JOIN live_jobs j ON j.id = x.job_id WHERE x.run_id = r.id AND x.deleted_at IS NULL) AS job_count,
        (SELECT count(*) FROM job_runs x JOIN live_jobs j ON j.id = x.job_id WHERE x.run_id = r.id AND x.deleted_at IS NULL AND j.status = 'failed') AS failed_job_count,
        (SELECT count(*) FROM artifacts a WHERE a.run_id = r.id AND a.deleted_at IS NULL) AS artifact_count,
        (SELECT count(*) FROM metrics m WHERE m.run_id = r.id AND m.deleted_at IS NULL) AS metric_count FROM runs r WHERE r.deleted_at IS NULL"""),
    "v_metric_coverage": (views.metric_coverage, """SELECT experiment_id, metric_name, count(DISTINCT run_id) AS run_count, t.n AS total_runs,
        count(DISTINCT run_id) / CAST(t.n AS DOUBLE) AS coverage FROM live_links JOIN metrics USING (run_id)
        JOIN (SELECT experiment_id, count(*) AS n FROM live_links GROUP BY 1) t USING (experiment_id)
        WHERE metrics.deleted_at IS NULL GROUP BY experiment_id, metric_name, t.n"""),
    "v_jobs_needing_attention": (views.jobs_needing_attention, """SELECT id AS job_id, experiment_id, run_id, name, status, launcher, external_system, external_id,
        retry_of, failure_reason, updated_at, started_at, finished_at FROM live_jobs WHERE status = 'failed' OR status IN ('submitting','unknown_submit','queued','running')"""),
    "v_artifact_latest_per_type": (views.artifact_latest_per_type, """SELECT id AS artifact_id, experiment_id, run_id, job_id, type, uri, content_hash, updated_at
        FROM artifacts a WHERE deleted_at IS NULL AND NOT EXISTS (FROM artifacts b WHERE b.deleted_at IS NULL AND b.type = a.type
        AND coalesce(b.experiment_id, '') = coalesce(a.experiment_id, '') AND coalesce(b.run_id, '') = coalesce(a.run_id, '')
        AND coalesce(b.job_id, '') = coalesce(a.job_id, '') AND (b.updated_at, b.id) > (a.updated_at, a.id))"""),
    "v_tracker_sync_coverage": (views.tracker_sync_coverage, """WITH hits AS (
        SELECT r.id AS rid, s.id, s.status, s.created_at FROM runs r JOIN sync_events s ON s.run_id = r.id WHERE s.target_system = 'wandb' AND s.origin = 'manifest'
        UNION SELECT r.id, s.id, s.status, s.created_at FROM runs r JOIN sync_events s ON s.target_identifier = r.external_id WHERE s.target_system = 'wandb' AND s.origin = 'manifest')
        SELECT r.id AS run_id, r.name AS run_name, r.external_system, r.external_id,
        CASE WHEN r.external_system = 'wandb' AND r.external_id IS NOT NULL THEN 1 ELSE 0 END AS has_tracker_external_id,
        h.st AS latest_sync_status, h.t_at AS latest_sync_at, coalesce(h.n, 0) AS sync_count FROM runs r
        LEFT JOIN (SELECT rid, arg_max(status, (created_at, id)) AS st, max(created_at) AS t_at, count(*) AS n FROM hits GROUP BY rid) h ON h.rid = r.id
        WHERE r.deleted_at IS NULL"""),
    "v_tracker_writeback_coverage": (views.tracker_writeback_coverage, """SELECT run_id AS source_run_id, source_entity_id, target_identifier, target_field, status AS latest_status,
        error_message AS latest_error_message, created_at AS latest_event_at, n AS attempt_count FROM (SELECT *,
        count(*) OVER w AS n, row_number() OVER (w ORDER BY created_at DESC, id DESC) AS k FROM sync_events
        WHERE target_system = 'wandb' AND origin = 'writeback' AND source_entity_type = 'metric' AND source_entity_id IS NOT NULL AND target_field IS NOT NULL
        WINDOW w AS (PARTITION BY source_entity_id, target_identifier, target_field)) z WHERE k = 1"""),
    "v_reconcile_log": (views.reconcile_log, """SELECT id AS reconcile_event_id, experiment_id, session_id, source, created_at, counts_json, inserts_json, updates_json,
        (SELECT count(*) FROM reconcile_operations o WHERE o.reconcile_event_id = e.id) AS operation_count FROM reconcile_events e"""),
    "v_artifacts_redacted": (views.artifacts_redacted, "SELECT * FROM redacted"),
    "v_jobs_with_recovery": (views.jobs_with_recovery, "SELECT * FROM recovery_view"),
    "v_experiment_blockers": (views.experiment_blockers, """
        SELECT id AS entity_id, experiment_id, 'job' AS entity_type, CASE WHEN status = 'failed' THEN 'blocking_failed_job'
        WHEN status = 'submitting' THEN 'submission_in_progress' ELSE 'submission_unknown' END AS blocker_type, status, updated_at, failure_reason AS message
        FROM recovery WHERE retry_state = 'blocking_failed' OR status IN ('submitting','unknown_submit')
        UNION ALL SELECT id, entity_id, 'validation', CASE status WHEN 'fail' THEN 'validation_failed' ELSE 'validation_unknown_blocking' END, status, updated_at, check_name
        FROM validations WHERE deleted_at IS NULL AND entity_type = 'experiment' AND (status = 'fail' OR (status = 'unknown' AND attrs_json LIKE '%"validation.blocking":true%'))"""),
    "v_runs_progress": (views.runs_progress, "SELECT * FROM progress"),
    "v_leases_active": (views.leases_active, """SELECT id AS lease_id, entity_type, entity_id, owner_agent, session_id, claimed_at, heartbeat_at, expires_at, attrs_json
        FROM leases WHERE released_at IS NULL AND coalesce(expires_at > :as_of, true)"""),
    "v_leases_stale": (views.leases_stale, """SELECT id AS lease_id, entity_type, entity_id, owner_agent, session_id, claimed_at, heartbeat_at, expires_at,
        CAST(1 AS DOUBLE) AS stale_threshold_hours, epoch_us(:as_of) / CAST(3600000000 AS DOUBLE) - epoch_us(heartbeat_at) / CAST(3600000000 AS DOUBLE) AS stale_hours, attrs_json
        FROM leases WHERE released_at IS NULL AND coalesce(expires_at > :as_of, true) AND heartbeat_at < :as_of - INTERVAL 1 HOUR"""),
    "v_experiment_ownership": (views.experiment_ownership, _OWN.format(k="experiment", t="experiments", extra="", join="")),
    "v_run_ownership": (views.run_ownership, _OWN.format(k="run", t="runs", extra="", join="")),
    "v_job_ownership": (views.job_ownership, _OWN.format(k="job", t="jobs", extra=", coalesce(d.depth, 0) AS retry_depth", join="LEFT JOIN depth_walk d ON d.id = x.id")),
    "v_dashboard_leases": (views.dashboard_leases, """SELECT l.id AS lease_id, l.entity_type, l.entity_id, o.experiment_id, l.owner_agent, l.session_id, l.claimed_at, l.heartbeat_at,
        l.expires_at, l.released_at, l.release_reason, l.attrs_json FROM leases l JOIN (
        SELECT 'experiment' AS t, id, id AS experiment_id FROM experiments UNION ALL SELECT 'run', run_id, experiment_id FROM experiment_runs
        UNION ALL SELECT 'job', j.id, coalesce(j.experiment_id, k.experiment_id) FROM jobs j LEFT JOIN experiment_runs k ON k.run_id = j.run_id) o
        ON o.t = l.entity_type AND o.id = l.entity_id"""),
    "v_dashboard_external_links": (views.dashboard_external_links, """SELECT coalesce(j.experiment_id, k.experiment_id) AS experiment_id, 'job' AS entity_type, j.id AS entity_id,
        j.external_system, j.external_id AS url FROM live_jobs j LEFT JOIN experiment_runs k ON k.run_id = j.run_id WHERE j.external_id ILIKE 'http%'
        UNION ALL SELECT experiment_id, 'artifact', id, NULL, uri FROM artifacts WHERE deleted_at IS NULL AND uri ILIKE 'http%'"""),
    "v_dashboard_experiments": (lifecycle.lifecycle, "SELECT * FROM lifecycle_all"),
    "experiment_groups": (lifecycle.experiment_groups, """SELECT CASE lifecycle_state WHEN 'needs_attention' THEN 'Needs attention'
        ELSE upper(lifecycle_state[1]) || lifecycle_state[2:] END AS display_group, lifecycle_state, count(*) AS experiment_count FROM lifecycle_all GROUP BY 2"""),
}
