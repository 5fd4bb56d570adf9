"""Table schemas and fixed value domains of the experiment ledger.

Timestamps are TIMESTAMP_NTZ in UTC.  Column lists are plain data so that both
the Spark side and the SQL text used for checking are generated from one place.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "d": T.DoubleType(),
    "ts": T.TimestampNTZType(),
}

# Table -> "column:type[*]" where * marks NOT NULL.
TABLE_COLUMNS: dict[str, list[str]] = {
    "experiments": ["id:s*", "name:s*", "description:s", "status:s*", "created_at:ts*", "updated_at:ts*",
                    "deleted_at:ts", "attrs_json:s*", "idempotency_key:s"],
    "experiment_tags": ["experiment_id:s*", "tag:s*"],
    "runs": ["id:s*", "name:s*", "description:s", "status:s*", "external_system:s", "external_id:s",
             "created_at:ts*", "updated_at:ts*", "deleted_at:ts", "attrs_json:s*", "parent_run_id:s",
             "experiment_id:s", "idempotency_key:s", "kind:s*"],
    "experiment_runs": ["experiment_id:s*", "run_id:s*", "created_at:ts*"],
    "jobs": ["id:s*", "experiment_id:s", "run_id:s", "name:s", "status:s*", "command:s", "launcher:s",
             "external_system:s", "external_id:s", "failure_reason:s", "code_commit:s", "code_dirty:i*",
             "created_at:ts*", "updated_at:ts*", "started_at:ts", "finished_at:ts", "deleted_at:ts",
             "attrs_json:s*", "retry_of:s"],
    "job_runs": ["job_id:s*", "run_id:s*", "role:s*", "status:s*", "started_at:ts", "finished_at:ts",
                 "failure_reason:s", "created_at:ts*", "updated_at:ts*", "deleted_at:ts", "attrs_json:s*"],
    "artifacts": ["id:s*", "run_id:s", "job_id:s", "experiment_id:s", "type:s*", "uri:s*", "content_hash:s",
                  "created_at:ts*", "updated_at:ts*", "deleted_at:ts", "attrs_json:s*"],
    "metrics": ["id:s*", "run_id:s*", "metric_name:s*", "value:d*", "step:s", "split:s", "source_job_id:s",
                "source_artifact_id:s", "created_at:ts*", "updated_at:ts*", "deleted_at:ts"],
    "notes": ["id:s*", "entity_type:s*", "entity_id:s*", "note_type:s*", "status:s*", "title:s", "body:s*",
              "body_format:s*", "author:s", "created_at:ts*", "updated_at:ts*", "resolved_at:ts",
              "deleted_at:ts", "attrs_json:s*"],
    "validations": ["id:s*", "entity_type:s*", "entity_id:s*", "check_name:s*", "status:s*",
                    "expected_value:s", "measured_value:s", "details_json:s*", "source_artifact_id:s",
                    "source_job_id:s", "session_id:s", "created_at:ts*", "updated_at:ts*", "deleted_at:ts",
                    "attrs_json:s*"],
    "leases": ["id:s*", "entity_type:s*", "entity_id:s*", "owner_agent:s*", "session_id:s", "claimed_at:ts*",
               "heartbeat_at:ts*", "expires_at:ts", "released_at:ts", "released_by:s",
               "released_session_id:s", "release_reason:s", "previous_lease_id:s", "attrs_json:s*"],
    "sessions": ["id:s*", "ledger_id:s*", "experiment_id:s", "agent:s*", "cwd:s", "git_root:s",
                 "git_worktree_dir:s", "git_branch:s", "git_commit:s", "intent:s", "started_at:ts*",
                 "last_touch_at:ts*", "ended_at:ts", "attrs_json:s*"],
    "sync_events": ["id:s*", "target_system:s*", "target_identifier:s", "status:s*", "run_id:s", "job_id:s",
                    "error_message:s", "created_at:ts*", "attrs_json:s*", "reconcile_event_id:s",
                    "idempotency_key:s", "origin:s*", "source_entity_type:s", "source_entity_id:s",
                    "target_field:s", "payload_summary_json:s"],
    "reconcile_events": ["id:s*", "experiment_id:s", "source:s*", "inserts_json:s*", "updates_json:s*",
                         "created_at:ts*", "attrs_json:s*", "counts_json:s*", "session_id:s"],
    "reconcile_operations": ["id:s*", "reconcile_event_id:s*", "op_index:i*", "entity:s*", "action:s*",
                             "entity_id:s", "input_json:s*", "diff_json:s*"],
    "refresh_events": ["id:s*", "source:s*", "experiment_id:s", "session_id:s", "status:s*", "stage:s*",
                       "started_at:ts*", "finished_at:ts*", "snapshot_path:s", "manifest_path:s",
                       "debug_path:s", "reconcile_event_id:s", "counts_json:s*", "command_argv_json:s*",
                       "error_message:s", "attrs_json:s*"],
    "schema_metadata": ["key:s*", "value:s*", "updated_at:ts*"],
}


def columns(table: str) -> list[tuple[str, str, bool]]:
    """(name, short type, nullable) of every column of ``table``."""
    out = []
    for spec in TABLE_COLUMNS[table]:
        name, kind = spec.rstrip("*").split(":")
        out.append((name, kind, not spec.endswith("*")))
    return out


def struct(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k], null) for n, k, null in columns(table)])


TABLES = list(TABLE_COLUMNS)
SCHEMA_VERSION = 18

# What identifies a row of each table.
KEYS: dict[str, tuple[str, ...]] = {t: ("id",) for t in TABLE_COLUMNS} | {
    "experiment_tags": ("experiment_id", "tag"), "experiment_runs": ("run_id", "experiment_id"), "job_runs": ("job_id", "run_id"), "schema_metadata": ("key",)}

# Keys that only one active row may hold; in optional columns null counts as "".
UNIQUE_KEYS: dict[str, tuple[str, ...]] = {
    "runs": ("external_system", "external_id"), "jobs": ("external_system", "external_id"), "artifacts": ("uri",),
    "metrics": ("run_id", "metric_name", "step", "split", "source_job_id", "source_artifact_id"), "validations": ("entity_type", "entity_id", "check_name")}
OPTIONAL_KEYS = {"step", "split", "source_job_id", "source_artifact_id"}

# Fixed value domains.
JOB_STATUSES = ["planned", "submitting", "unknown_submit", "queued", "running", "succeeded", "failed",
                "killed", "skipped", "unknown"]
ACTIVE_JOB_STATUSES = ["submitting", "unknown_submit", "queued", "running"]
UNCERTAIN_JOB_STATUSES = ["submitting", "unknown_submit"]
TERMINAL_JOB_STATUSES = ["succeeded", "failed", "killed", "skipped"]
RUN_STATUSES = ["active", "archived"]
RUN_KINDS = ["datapoint", "aggregate", "analysis", "external"]
JOB_RUN_ROLES = ["train", "eval", "export", "analyze", "collect", "other"]
ARTIFACT_TYPES = ["checkpoint", "eval-result", "metric-table", "validation-report", "plot", "report", "log",
                  "wandb-run", "manifest", "other"]
NOTE_TYPES = ["research", "debug", "handoff", "next-action", "decision", "checkpoint", "review"]
NOTE_STATUSES = ["open", "resolved", "superseded"]
NOTE_BODY_FORMATS = ["markdown", "plain"]
SYNC_STATUSES = ["pending", "synced", "failed", "skipped"]
ENTITY_TYPES = ["experiment", "run", "job", "artifact", "metric"]
VALIDATION_STATUSES = ["pass", "fail", "warning", "unknown"]
RUN_PHASES = ["complete", "evaluated", "failed", "planned", "skipped", "submitted", "trained", "training"]
LIFECYCLE_STATES = ["needs_attention", "running", "review", "open", "archived"]

ENTITY_TABLE = {"experiment": "experiments", "run": "runs", "job": "jobs", "artifact": "artifacts",
                "metric": "metrics"}
ATTR_TABLES = {"experiments": "experiment", "runs": "run", "jobs": "job", "artifacts": "artifact",
               "notes": "note", "reconcile_events": "reconcile_event", "sync_events": "sync_event",
               "sessions": "session", "validations": "validation", "refresh_events": "refresh_event"}

NOTE_TITLE_MAX_CHARS = 120
NOTE_BODY_MAX_BYTES = 64 * 1024

# Fixed patterns.
UTC_Z_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
ATTR_KEY_PATTERN = r"^[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+$"
SHA256_PATTERN = r"^sha256:[0-9a-fA-F]{64}$"
IDEMPOTENCY_KEY_PATTERN = r"^[a-z0-9][a-z0-9._-]{0,127}$"
SECRET_PATTERNS = {
    "api_key_assignment": r"(?:API_KEY|TOKEN|SECRET|PASSWORD)=[^\s'\"]{8,}",
    "openai_style_key": r"sk-[A-Za-z0-9_-]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
}

# Reserved attribute namespace of this library.
ATTR_PREFIX = "ledger."
ATTR_ERRATUM = "ledger.erratum"
ATTR_ERRATUM_AT = "ledger.erratum_at"
ATTR_ERRATUM_SESSION = "ledger.erratum_session_id"
ATTR_REPLACES = "ledger.replaces"
ATTR_REVIEWED_COUNT = "ledger.reviewed_activity_count"
ATTR_LOCAL_MTIME = "ledger.local_mtime_at_capture"
ATTR_LOCAL_SIZE = "ledger.local_size_at_capture"
ATTR_LOCAL_PATH = "ledger.local_path_at_capture"
ATTR_BLOCKING = "validation.blocking"
ATTR_EXPECTED_RUNS = "progress.expected_runs"
ATTR_REQUIRED_METRICS = "progress.required_metrics"
