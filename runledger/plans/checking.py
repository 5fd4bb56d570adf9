"""Assembling checking SQL (DuckDB) on top of the projection relations."""

from __future__ import annotations

import re

from runledger.projection import RELATIONS, dependencies, duckdb_relation

# Helper CTEs shared by several checks; each may use projection relations and earlier helpers.
HELPERS: dict[str, str] = {
    "live_jobs": "SELECT * FROM jobs WHERE deleted_at IS NULL",
    "retry_walk": (
        "SELECT p.id AS root, c.id AS node, c.status AS node_status, [p.id, c.id] AS path, 1 AS d "
        "FROM live_jobs p JOIN live_jobs c ON c.retry_of = p.id "
        "UNION ALL SELECT w.root, c.id, c.status, list_append(w.path, c.id), w.d + 1 FROM retry_walk w "
        "JOIN live_jobs c ON c.retry_of = w.node WHERE NOT list_contains(w.path, c.id)"),
    "recovery": (
        "SELECT j.*, w.s AS success_id, w.a AS active_id, "
        "CASE WHEN j.status = 'failed' THEN CASE WHEN w.s IS NOT NULL THEN 'recovered_failed' "
        "WHEN w.a IS NOT NULL THEN 'recovery_in_progress' ELSE 'blocking_failed' END END AS retry_state "
        "FROM live_jobs j LEFT JOIN (SELECT root, min(node) FILTER (WHERE node_status = 'succeeded') AS s, "
        "min(node) FILTER (WHERE node_status IN ('submitting','unknown_submit','queued','running')) AS a "
        "FROM retry_walk GROUP BY root) w ON w.root = j.id"),
    "live_links": (
        "SELECT experiment_id, run_id FROM experiment_runs WHERE run_id IN (SELECT id FROM runs WHERE deleted_at IS NULL)"),
    # every (job, experiment) pair by the job's own column and by its run's links
    "job_owner": (
        "SELECT id AS job_id, experiment_id FROM jobs WHERE experiment_id IS NOT NULL "
        "UNION SELECT jobs.id, experiment_runs.experiment_id FROM jobs JOIN experiment_runs USING (run_id)"),
    "artifact_owner": (
        "SELECT id AS artifact_id, experiment_id FROM artifacts WHERE experiment_id IS NOT NULL "
        "UNION SELECT artifacts.id, experiment_runs.experiment_id FROM artifacts JOIN experiment_runs USING (run_id) "
        "UNION SELECT artifacts.id, job_owner.experiment_id FROM artifacts JOIN job_owner USING (job_id)"),
    "entity_all": (
        "SELECT 'experiment' AS entity_type, id AS entity_id, deleted_at FROM experiments "
        "UNION ALL SELECT 'run', id, deleted_at FROM runs UNION ALL SELECT 'job', id, deleted_at FROM jobs "
        "UNION ALL SELECT 'artifact', id, deleted_at FROM artifacts UNION ALL SELECT 'metric', id, deleted_at FROM metrics"),
    "owner_all": (
        "SELECT 'experiment' AS entity_type, id AS entity_id, id AS experiment_id FROM experiments "
        "UNION SELECT 'run', run_id, experiment_id FROM experiment_runs UNION SELECT 'job', job_id, experiment_id FROM job_owner "
        "UNION SELECT 'artifact', artifact_id, experiment_id FROM artifact_owner "
        "UNION SELECT 'metric', metrics.id, experiment_runs.experiment_id FROM metrics JOIN experiment_runs USING (run_id)"),
    "lease_owner": (
        "SELECT 'experiment' AS entity_type, id AS entity_id, id AS experiment_id FROM experiments "
        "UNION SELECT 'run', run_id, experiment_id FROM experiment_runs UNION SELECT 'job', job_id, experiment_id FROM job_owner "
        "UNION SELECT 'job', job_runs.job_id, experiment_runs.experiment_id FROM job_runs JOIN experiment_runs USING (run_id) "
        "JOIN jobs ON jobs.id = job_runs.job_id WHERE job_runs.deleted_at IS NULL"),
    "audit_run": (
        "SELECT run_id, experiment_id FROM experiment_runs UNION SELECT id, experiment_id FROM runs WHERE experiment_id IS NOT NULL"),
    "audit_job": (
        "SELECT id AS job_id, experiment_id FROM jobs WHERE experiment_id IS NOT NULL "
        "UNION SELECT jobs.id, audit_run.experiment_id FROM jobs JOIN audit_run USING (run_id) "
        "UNION SELECT job_runs.job_id, audit_run.experiment_id FROM job_runs JOIN audit_run USING (run_id) "
        "JOIN jobs ON jobs.id = job_runs.job_id WHERE job_runs.deleted_at IS NULL"),
    "audit_owner": (
        "SELECT 'experiment' AS entity_type, id AS entity_id, id AS experiment_id FROM experiments "
        "UNION SELECT 'run', run_id, experiment_id FROM audit_run UNION SELECT 'job', job_id, experiment_id FROM audit_job "
        "UNION SELECT 'artifact', id, experiment_id FROM artifacts WHERE experiment_id IS NOT NULL "
        "UNION SELECT 'artifact', artifacts.id, audit_run.experiment_id FROM artifacts JOIN audit_run USING (run_id) "
        "UNION SELECT 'artifact', artifacts.id, audit_job.experiment_id FROM artifacts JOIN audit_job USING (job_id)"),
}

AS_OF_SQL = "TIMESTAMP '2001-12-01 00:00:00'"


def register(name: str, sql: str) -> None:
    if name in HELPERS and HELPERS[name] != sql:
        raise ValueError(f"helper {name} already defined")
    HELPERS[name] = sql


def checking_sql(body: str) -> str:
    """Full statement: projection relations, helpers, the body's own CTEs, final SELECT."""
    body = body.replace(":as_of", AS_OF_SQL).strip()
    used: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        words = set(re.findall(r"[a-z_]+", re.sub(r"'(?:[^']|'')*'", "", text)))
        for name, sql in HELPERS.items():
            if name in words and name not in used and name not in path:
                visit(sql, (*path, name))
                used.append(name)

    visit(body, ())
    text = body + " " + " ".join(HELPERS[h] for h in used)
    deps = dependencies(text)
    parts = []
    for name in RELATIONS:
        if name in deps:
            hint = " MATERIALIZED" if name in ("li_seq", "jobs") else ""
            parts.append(f"{name} AS{hint} ({duckdb_relation(name)})")
    for name in used:
        hint = "" if name in ("retry_walk", "retry_climb") else " MATERIALIZED"
        parts.append(f"{name} AS{hint} ({HELPERS[name].replace(':as_of', AS_OF_SQL)})")
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH RECURSIVE " + ",\n".join(parts)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
