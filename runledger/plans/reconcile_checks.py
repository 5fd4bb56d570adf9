"""Reconcile queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions import validate as v
from runledger.lineage import CODEC, cut
from runledger.operators import integrity
from runledger.operators import reconcile as rc
from runledger.plans.checking import register
from runledger.schemas import NOTE_TYPES

_NEW = "'{p}_' || substr(sha256('{s}|2001-12-01 00:00:00|' || (SELECT count(*) FROM reconcile_events) || '|' || m.row_index), 1, 26)"
_PLAN_COLS = ["row_index", "action", "target_id AS entity_id", "existing_id", "error"]
_GONE = "(SELECT id FROM experiments WHERE deleted_at IS NOT NULL)"


def _new(section, prefix):
    return _NEW.format(s=section, p=prefix)


def _planned(fn, table, *extra):
    return lambda l: fn(l, l.tables[table]).selectExpr(*_PLAN_COLS, *extra)


register("plan_j", """
 SELECT m.row_index, m.op, m.status, m.name, m.experiment_id, m.attrs_json, m.id AS entity_id, j.id AS existing_id, j.status AS old_status, j.experiment_id AS old_exp, j.attrs_json AS old_attrs, j.deleted_at AS old_del,
  CASE WHEN m.op = 'archive' AND j.id IS NULL THEN 'row to archive not found' WHEN m.op = 'archive' THEN NULL WHEN m.status = 'weird' THEN 'invalid job status ''weird'''
   WHEN e.deleted_at IS NOT NULL THEN 'experiment is archived and cannot be reconciled' END AS error
 FROM man_jobs m LEFT JOIN jobs j ON j.id = m.id LEFT JOIN experiments e ON e.id = m.experiment_id""")
register("plan_jobs_all", """
 SELECT *, CASE WHEN op = 'archive' THEN CASE WHEN old_del IS NULL THEN 'archive' ELSE 'noop' END WHEN existing_id IS NULL THEN 'insert' WHEN diff = '{}' THEN 'noop' ELSE 'update' END AS action
 FROM (SELECT *, '{' || concat_ws(',', CASE WHEN attrs_json IS NOT NULL THEN '"attrs":[{},{"a.y":"z","b.x":1}]' END,
   CASE WHEN experiment_id <> coalesce(old_exp, '') THEN '"experiment_id":[' || coalesce('"' || old_exp || '"', 'null') || ',"' || experiment_id || '"]' END,
   CASE WHEN status <> old_status THEN '"status":["' || old_status || '","' || status || '"]' END) || '}' AS diff FROM plan_j) z""")
register("plan_runs_all", f"""
 SELECT m.*, CASE WHEN m.id IS NOT NULL THEN a.id WHEN m.idempotency_key IS NOT NULL AND m.experiment_id IS NOT NULL THEN b.id ELSE c.id END AS existing_id FROM man_runs m
 LEFT JOIN runs a ON a.id = m.id
 LEFT JOIN runs b ON b.experiment_id = m.experiment_id AND b.idempotency_key = m.idempotency_key AND b.deleted_at IS NULL
 LEFT JOIN (SELECT external_system, external_id, min(id) AS id FROM runs WHERE deleted_at IS NULL AND external_id IS NOT NULL GROUP BY ALL) c ON c.external_system = m.external_system AND c.external_id = m.external_id""")
_RUN_ID = f"coalesce(m.existing_id, m.id, {_new('runs', 'run')})"
register("owned_gone", f"SELECT entity_type, entity_id FROM owner_all WHERE experiment_id IN {_GONE} UNION SELECT 'experiment', id FROM experiments WHERE deleted_at IS NOT NULL")


def _actions(l):
    ops = rc.Plan({"jobs": rc.plan_jobs(l, l.tables["man_jobs"]), "metrics": rc.plan_metrics(l, l.tables["man_metrics"])}, None).operations
    return ops.filter("error IS NULL")


def _apply(section, fn, table):
    def run(l):
        good = cut(fn(l, l.tables[table]).filter("error IS NULL"), "checked-plan", CODEC)
        return rc.apply_updates(l, rc.Plan({section: good}, None))[section]
    return run


def _references(l):
    """Reference errors of a manifest that also names rows nobody has."""
    n = F.col("row_index")
    metrics = l.tables["man_metrics"].withColumn("run_id", F.when(n % 7 == 3, F.concat(F.lit("ghost_"), "run_id")).otherwise(F.col("run_id"))).withColumn(
        "source_job_id", F.when(n % 11 == 5, F.concat("source_job_id", F.lit("q"))).otherwise(F.col("source_job_id")))
    jobs = l.tables["man_jobs"].withColumn("run_id", F.when(n % 13 == 1, F.concat(F.lit("run_z"), n.cast("string")))).withColumn(
        "retry_of", F.when(n % 17 == 2, F.lit("job_none")).when(n % 17 == 3, F.regexp_replace("id", "^new_", "job_")))
    sections = {"jobs": cut(rc.plan_jobs(l, jobs), "plan-jobs"), "job_runs": cut(rc.plan_job_runs(l, l.tables["man_edges"]), "plan-edges"), "metrics": cut(rc.plan_metrics(l, metrics), "plan-metrics")}
    return integrity.reference_errors(l, sections)


def _uniques(l):
    """Errors of a manifest that moves every third job onto an external id that may be taken, free or asked for twice."""
    n = F.col("row_index")
    order, seq = F.split_part("id", F.lit("_"), F.lit(2)), F.split_part("id", F.lit("_"), F.lit(3)).cast("int")
    wanted = (F.when(n % 7 < 3, F.concat(F.lit("https://sched.example/j"), order, F.lit("-"), (seq + 1).cast("string")))
              .when(n % 11 == 1, F.concat(F.lit("https://twice/"), F.substring(order, -3, 3))).otherwise(F.concat(F.lit("https://free/"), "id")))
    jobs = l.tables["man_jobs"].filter(n % 3 == 0).select("row_index", "id", F.lit("upsert").alias("op"), F.lit("sched").alias("external_system"), wanted.alias("external_id"))
    return integrity.unique_errors(l, {"jobs": cut(rc.plan_jobs(l, jobs), "plan-jobs")})


def _retries(l):
    """Retry errors that a manifest causes: self retries, lost targets, archived targets and rings of two."""
    n = F.col("row_index")
    order, seq = F.split_part("id", F.lit("_"), F.lit(2)), F.split_part("id", F.lit("_"), F.lit(3)).cast("int")
    nxt = F.concat(F.lit("job_"), order, F.lit("_"), (seq + 1).cast("string"))
    jobs = l.tables["man_jobs"].filter(F.col("id").startswith("job_") & (n % 3 == 0)).select(
        "row_index", "id", F.when(n % 5 == 4, "archive").otherwise("upsert").alias("op"),
        F.when(n % 7 == 1, F.col("id")).when(n % 7 == 2, F.lit("job_none")).when(n % 7 == 3, nxt).alias("retry_of"))
    return rc.manifest_retry_errors(l, cut(rc.plan_jobs(l, jobs), "plan-jobs"))


def _dedupe(l):
    # rows lose their id, and every fourth one repeats the external id of its neighbour
    n = F.col("row_index")
    rows = l.tables["man_runs"].withColumn("id", F.lit(None).cast("string")).withColumn("external_system", F.lit("wandb")).withColumn(
        "external_id", F.concat(F.lit("d"), F.floor(n / 4).cast("string")))
    out = rc.dedupe_external("runs", rc.normalize("runs", rows))
    return out.select("row_index", "external_id", "name", "experiment_id", "idempotency_key", "parent_run_id")


def _bodies(l):
    return l.table("notes").select("id", rc.audit_text(F.col("body")).alias("logged")).select(
        "id", F.get_json_object("logged", "$.byte_count").cast("bigint").alias("byte_count"), F.get_json_object("logged", "$.sha256").alias("sha256"), F.get_json_object("logged", "$.preview").alias("preview"))


def _fields(l):
    """Field checks over note, validation and raw job rows at once."""
    n = l.tables["man_notes"].select(F.col("row_index").cast("string").alias("key"), F.array_join(v.errors(
        v.choice("note_type", NOTE_TYPES, "note type"), v.note_title("title"), v.note_body("body")), ";").alias("errors"))
    t = l.table("experiment_tags").select(F.concat_ws("/", "experiment_id", "tag").alias("key"), F.array_join(v.errors(v.tag(F.concat(F.lit(" "), "tag", F.when(F.length("tag") == 9, " x").otherwise(" ")))), ";").alias("errors"))
    k = l.table("experiments").filter("idempotency_key IS NOT NULL").select(F.col("id").alias("key"), F.array_join(v.errors(v.idempotency_key(F.regexp_replace("idempotency_key", "7$", "7 "))), ";").alias("errors"))
    return n.unionByName(t).unionByName(k)


def _upsert(l):
    n = F.regexp_extract("id", "[0-9]+", 0).cast("bigint")
    fresh = l.table("experiments").select(F.concat(F.lit("up_"), "id").alias("id"), "name", "status", "created_at", "updated_at", F.when(n % 4 == 0, F.col("idempotency_key")).otherwise(F.concat(F.lit("fresh-"), "id")).alias("idempotency_key"))
    return rc.upsert_keep_existing(l, "experiments", fresh).select("id", "idempotency_key")


register("man_retries", """SELECT row_index, id, CASE WHEN row_index%5=4 THEN 'archive' ELSE 'upsert' END AS op, CASE WHEN row_index%7=1 THEN id WHEN row_index%7=2 THEN 'job_none'
 WHEN row_index%7=3 THEN 'job_' || split_part(id,'_',2) || '_' || (CAST(split_part(id,'_',3) AS INT)+1) END AS retry_of FROM man_jobs WHERE id LIKE 'job~_%' ESCAPE '~' AND row_index%3=0""")
register("retry_said", "SELECT id, retry_of FROM man_retries WHERE op = 'upsert'")
register("retry_gone", "SELECT m.id FROM man_retries m JOIN jobs j ON j.id = m.id WHERE m.op = 'archive' AND j.deleted_at IS NULL")
register("jobs_then", """SELECT j.id, CASE WHEN s.id IS NULL THEN j.retry_of ELSE s.retry_of END AS retry_of, s.id IS NOT NULL AND s.retry_of IS NOT NULL AS said FROM jobs j LEFT JOIN retry_said s ON s.id = j.id
 WHERE (j.deleted_at IS NULL OR s.id IS NOT NULL) AND j.id NOT IN (FROM retry_gone)""")
register("edges_then", "SELECT a.id, a.retry_of AS parent, a.said FROM jobs_then a JOIN jobs_then b ON b.id = a.retry_of WHERE a.retry_of <> a.id")
register("retry_climb", """SELECT id AS root, parent AS node, said, 1 AS d FROM edges_then UNION ALL
 SELECT w.root, e.parent, w.said OR e.said, w.d + 1 FROM retry_climb w JOIN edges_then e ON e.id = w.node WHERE w.node <> w.root AND w.d < 20""")
register("man_moves", """SELECT m.row_index, m.id, CASE WHEN row_index%7<3 THEN 'https://sched.example/j' || split_part(m.id,'_',2) || '-' || (CAST(split_part(m.id,'_',3) AS INT)+1)
 WHEN row_index%11=1 THEN 'https://twice/' || right(split_part(m.id,'_',2), 3) ELSE 'https://free/' || m.id END AS ext FROM man_jobs m WHERE row_index%3=0""")
register("moves", """SELECT m.row_index, coalesce(j.id, m.id) AS id, m.ext, j.id IS NULL AS fresh FROM man_moves m LEFT JOIN jobs j ON j.id = m.id
 LEFT JOIN (SELECT DISTINCT external_id FROM jobs WHERE deleted_at IS NULL AND external_system = 'sched') x ON x.external_id = m.ext
 WHERE (j.id IS NOT NULL AND j.deleted_at IS NULL AND m.ext IS DISTINCT FROM j.external_id) OR (j.id IS NULL AND x.external_id IS NULL)""")

_ORDERED = """SELECT CAST(row_number() OVER (ORDER BY CASE action WHEN 'insert' THEN 0 WHEN 'update' THEN 2 WHEN 'noop' THEN 4 ELSE 5 END, CASE section WHEN 'jobs' THEN 1 ELSE 4 END, row_index) - 1 AS INT) AS op_index, section, action, row_index
 FROM (SELECT 'jobs' AS section, action, row_index FROM plan_jobs_all WHERE error IS NULL UNION ALL SELECT 'metrics', action, row_index FROM plan_metrics_all WHERE error IS NULL) z"""
register("plan_metrics_all", f"""
 SELECT m.*, x.id AS existing_id, x.value AS old_value, CASE WHEN m.value = 'oops' THEN 'metric value must be numeric' END AS error, coalesce(x.id, {_new('metrics', 'met')}) AS entity_id,
  CASE WHEN x.id IS NULL THEN 'insert' WHEN TRY_CAST(m.value AS DOUBLE) IS NOT DISTINCT FROM x.value THEN 'noop' ELSE 'update' END AS action
 FROM man_metrics m LEFT JOIN (SELECT * FROM metrics WHERE deleted_at IS NULL) x ON x.run_id = m.run_id AND x.metric_name = m.metric_name AND coalesce(x.step, '') = coalesce(m.step, '')
  AND coalesce(x.split, '') = coalesce(m.split, '') AND coalesce(x.source_job_id, '') = coalesce(m.source_job_id, '') AND coalesce(x.source_artifact_id, '') = coalesce(m.source_artifact_id, '')""")
register("man_art_owner", """SELECT row_index, experiment_id FROM man_artifacts WHERE experiment_id IS NOT NULL UNION SELECT m.row_index, k.experiment_id FROM man_artifacts m JOIN experiment_runs k ON k.run_id = m.run_id""")
register("plan_notes_src", """SELECT m.*, n.id AS existing_id, n.status AS old_status, n.title AS old_title, n.body AS old_body, n.deleted_at AS old_del, n.attrs_json AS old_attrs,
  (m.entity_type, m.entity_id) IN (SELECT (entity_type, entity_id) FROM owned_gone) AS gone FROM man_notes m LEFT JOIN notes n ON n.id = m.id""")
register("plan_checks_src", """SELECT m.*, x.id AS existing_id, x.status AS old_status, x.source_artifact_id AS old_src, e.deleted_at AS target_del, e.id AS target FROM man_checks m
  LEFT JOIN (SELECT * FROM validations WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, check_name ORDER BY id) = 1) x
   ON x.entity_type = m.entity_type AND x.entity_id = m.entity_id AND x.check_name = m.check_name
  LEFT JOIN experiments e ON e.id = m.entity_id""")

RECONCILE = {
    "plan_jobs": (_planned(rc.plan_jobs, "man_jobs", "diff_json"), "SELECT row_index, action, CASE WHEN op = 'archive' THEN existing_id ELSE entity_id END AS entity_id, existing_id, error, "
        "CASE WHEN action = 'update' THEN diff ELSE '{}' END AS diff_json FROM plan_jobs_all"),
    "plan_runs": (_planned(rc.plan_runs, "man_runs"), f"""SELECT m.row_index, CASE WHEN m.existing_id IS NULL THEN 'insert' WHEN (m.name IS NOT NULL AND m.name <> r.name) OR (m.parent_run_id IS NOT NULL AND m.parent_run_id IS DISTINCT FROM r.parent_run_id)
        OR (m.experiment_id IS NOT NULL AND m.experiment_id <> r.experiment_id) OR (m.experiment_id IS NOT NULL AND NOT EXISTS (FROM experiment_runs k WHERE k.experiment_id = m.experiment_id AND k.run_id = m.existing_id))
        OR (m.idempotency_key IS NOT NULL AND m.idempotency_key <> r.idempotency_key) THEN 'update' ELSE 'noop' END AS action, {_RUN_ID} AS entity_id, m.existing_id,
        CASE WHEN m.idempotency_key = 'Bad Key' THEN 'malformed idempotency key' WHEN m.parent_run_id = {_RUN_ID} THEN 'parent run cannot be the run itself'
        WHEN m.parent_run_id IS NOT NULL AND m.parent_run_id NOT IN (SELECT id FROM runs) THEN 'parent run does not exist' WHEN m.experiment_id IS NOT NULL AND m.experiment_id NOT IN (SELECT id FROM experiments) THEN 'experiment not found'
        WHEN m.experiment_id IN {_GONE} THEN 'experiment is archived and cannot be reconciled' WHEN m.existing_id IS NULL AND m.name IS NULL THEN 'new runs need a name' END AS error
        FROM plan_runs_all m LEFT JOIN runs r ON r.id = m.existing_id"""),
    "plan_job_runs": (_planned(rc.plan_job_runs, "man_edges", "diff_json"), """SELECT m.row_index, CASE WHEN k.job_id IS NULL THEN 'insert' WHEN m.status <> k.status OR k.deleted_at IS NOT NULL THEN 'update' ELSE 'noop' END AS action,
        concat_ws(':', m.job_id, m.run_id) AS entity_id, k.job_id || ':' || k.run_id AS existing_id, CASE WHEN m.job_id IS NULL THEN 'missing required field ''job_id''' WHEN k.role <> m.role THEN 'job-run role cannot change' END AS error,
        '{' || concat_ws(',', CASE WHEN k.deleted_at IS NOT NULL THEN '"deleted_at":["' || strftime(k.deleted_at, '%Y-%m-%dT%H:%M:%SZ') || '",null]' END,
        CASE WHEN m.status <> k.status THEN '"status":["' || k.status || '","' || m.status || '"]' END) || '}' AS diff_json
        FROM man_edges m LEFT JOIN job_runs k ON k.job_id = m.job_id AND k.run_id = m.run_id"""),
    "plan_metrics": (_planned(rc.plan_metrics, "man_metrics"), "SELECT row_index, action, entity_id, existing_id, error FROM plan_metrics_all"),
    "plan_artifacts": (_planned(rc.plan_artifacts, "man_artifacts"), f"""SELECT m.row_index, CASE WHEN m.errata AND a.id IS NOT NULL THEN 'errata_replace' WHEN a.id IS NULL THEN 'insert' WHEN a.type <> m.type
        OR (m.run_id IS NOT NULL AND m.run_id IS DISTINCT FROM a.run_id) OR (m.experiment_id IS NOT NULL AND m.experiment_id IS DISTINCT FROM a.experiment_id) THEN 'update' ELSE 'noop' END AS action,
        CASE WHEN m.errata THEN {_new('artifacts', 'art')} ELSE coalesce(a.id, {_new('artifacts', 'art')}) END AS entity_id, a.id AS existing_id,
        CASE WHEN m.type = 'nope' THEN 'invalid artifact type ''nope''' WHEN m.experiment_id IN {_GONE} AND NOT m.errata THEN 'experiment is archived and cannot be reconciled'
        WHEN NOT m.errata AND EXISTS (FROM man_art_owner o WHERE o.row_index = m.row_index AND o.experiment_id IN {_GONE}) THEN 'artifact targets an archived experiment and needs errata'
        WHEN m.errata AND a.id IS NOT NULL AND EXISTS (FROM man_art_owner o WHERE o.row_index = m.row_index) AND EXISTS (FROM artifact_owner o WHERE o.artifact_id = a.id)
         AND NOT EXISTS (FROM man_art_owner o JOIN artifact_owner p ON p.experiment_id = o.experiment_id WHERE o.row_index = m.row_index AND p.artifact_id = a.id) THEN 'artifact URI already belongs to other experiments' END AS error
        FROM man_artifacts m LEFT JOIN artifacts a ON a.uri = m.uri AND a.deleted_at IS NULL"""),
    "plan_notes": (_planned(rc.plan_notes, "man_notes"), f"""SELECT row_index, CASE WHEN op = 'archive' THEN CASE WHEN old_del IS NULL THEN 'archive' ELSE 'noop' END WHEN existing_id IS NULL THEN 'insert'
        WHEN status <> old_status OR errata OR (title IS NOT NULL AND trim(title) IS DISTINCT FROM old_title) OR (body IS NOT NULL AND body <> old_body) THEN 'update' ELSE 'noop' END AS action,
        CASE WHEN op = 'archive' THEN existing_id ELSE id END AS entity_id, existing_id,
        CASE WHEN op = 'archive' THEN CASE WHEN existing_id IS NULL THEN 'row to archive not found' END WHEN gone AND NOT errata THEN 'note targets an archived experiment and needs errata' WHEN note_type = 'poem' THEN 'invalid note type ''poem'''
        WHEN trim(title) = '' THEN 'note title must not be empty' WHEN length(title) > 120 THEN 'note title is longer than 120 characters' WHEN existing_id IS NULL AND body IS NULL THEN 'new notes need a body'
        WHEN existing_id IS NOT NULL AND gone THEN 'notes of archived experiments cannot be updated' END AS error FROM plan_notes_src"""),
    "plan_validations": (_planned(rc.plan_validations, "man_checks"), f"""SELECT row_index, CASE WHEN errata AND existing_id IS NOT NULL THEN 'errata_replace' WHEN existing_id IS NULL THEN 'insert'
        WHEN status <> old_status OR (source_artifact_id IS NOT NULL AND source_artifact_id <> old_src) OR details_json LIKE '{{"%' THEN 'update' ELSE 'noop' END AS action,
        CASE WHEN errata THEN {_new('validations', 'val')} ELSE coalesce(existing_id, {_new('validations', 'val')}) END AS entity_id, existing_id,
        CASE WHEN status = 'maybe' THEN 'invalid validation status ''maybe''' WHEN target IS NULL THEN 'validation entity does not exist' WHEN target_del IS NOT NULL AND NOT errata THEN 'validation targets an archived experiment and needs errata'
        WHEN details_json = '[1]' THEN 'validation details must be an object' WHEN source_artifact_id IS NOT NULL AND source_artifact_id NOT IN (SELECT id FROM artifacts WHERE deleted_at IS NULL) THEN 'source artifact does not exist' END AS error
        FROM plan_checks_src m"""),
    "plan_custom_attributes": (lambda l: rc.plan_custom_attributes(l, l.tables["man_attrs"]).select("row_index", "action", "entity_id", "error", "diff_json"), """SELECT m.row_index, m.entity_id,
        CASE WHEN t.id IS NULL THEN 'custom attribute target not found' WHEN m.attrs_json IS NULL THEN 'custom attributes need an attrs object' WHEN m.attrs_json LIKE '%Bad%' THEN 'attribute keys must be lowercase dotted names' END AS error,
        CASE WHEN coalesce(m.attrs_json, '{}') = '{}' THEN 'noop' ELSE 'update' END AS action,
        CASE WHEN coalesce(m.attrs_json, '{}') = '{}' OR t.id IS NULL OR m.attrs_json LIKE '%Bad%' THEN '{}' ELSE '{"attrs":[' || t.base || ',' || CASE WHEN t.base = '{}' THEN m.attrs_json WHEN m.attrs_json LIKE '%Bad%' THEN '{"Bad":1,' || t.base[2:] ELSE m.attrs_json[:-2] || ',' || t.base[2:] END || ']}' END AS diff_json
        FROM man_attrs m LEFT JOIN (SELECT 'run' AS k, id, '{}' AS base FROM runs UNION ALL SELECT 'job', id, '{}' FROM jobs
         UNION ALL SELECT 'experiment', id, CASE WHEN attrs_json LIKE '{"%' THEN attrs_json ELSE '{}' END FROM experiments) t ON t.k = m.entity_type AND t.id = m.entity_id"""),
    "plan_sync_events": (lambda l: rc.plan_sync_events(l, l.tables["man_sync"]).selectExpr(*_PLAN_COLS), f"""SELECT m.row_index, CASE WHEN x.id IS NULL THEN 'sync_event' ELSE 'noop' END AS action,
        coalesce(x.id, {_new('sync_events', 'sync')}) AS entity_id, x.id AS existing_id, CASE WHEN m.target_system IS NULL THEN 'missing required field ''target_system''' WHEN origin = 'writeback' THEN 'manifests cannot add writeback events'
        WHEN m.status = 'lost' THEN 'invalid sync event status ''lost''' END AS error FROM man_sync m LEFT JOIN (SELECT target_system, coalesce(target_identifier, '') AS ti, idempotency_key, min(id) AS id FROM sync_events
        WHERE origin = 'manifest' AND idempotency_key IS NOT NULL GROUP BY ALL) x ON x.target_system = m.target_system AND x.ti = coalesce(m.target_identifier, '') AND x.idempotency_key = m.idempotency_key"""),
    "plan_archive": (lambda l: rc.plan_jobs(l, l.tables["man_jobs"].withColumn("op", F.lit("archive"))).selectExpr(*_PLAN_COLS), """SELECT row_index, CASE WHEN old_del IS NOT NULL THEN 'noop' ELSE 'archive' END AS action, existing_id AS entity_id, existing_id,
        CASE WHEN existing_id IS NULL THEN 'row to archive not found' END AS error FROM plan_jobs_all"""),
    "match_existing": (lambda l: rc.match_existing(l, "runs", rc.normalize("runs", l.tables["man_runs"])), "SELECT row_index, existing_id FROM plan_runs_all WHERE existing_id IS NOT NULL"),
    "dedupe_external": (_dedupe, """SELECT min(row_index) AS row_index, 'd' || CAST(row_index // 4 AS BIGINT) AS external_id, arg_max(name, row_index) AS name, arg_max(experiment_id, row_index) AS experiment_id,
        arg_max(idempotency_key, row_index) AS idempotency_key, arg_max(parent_run_id, row_index) AS parent_run_id FROM man_runs GROUP BY row_index // 4"""),
    "row_diff": (lambda l: rc.plan_jobs(l, l.tables["man_jobs"]).filter("action = 'update'").select("row_index", "diff_json"), "SELECT row_index, diff AS diff_json FROM plan_jobs_all WHERE action = 'update'"),
    "count_operations": (lambda l: rc.count_operations(_actions(l)), "SELECT section, action, count(*) AS n FROM (SELECT 'jobs' AS section, action FROM plan_jobs_all WHERE error IS NULL UNION ALL SELECT 'metrics', action FROM plan_metrics_all WHERE error IS NULL) z GROUP BY ALL"),
    "order_operations": (lambda l: rc.order_operations(_actions(l)).select("op_index", "section", "action", F.col("row_index").cast("bigint").alias("row_index")), _ORDERED),
    "apply_updates_jobs": (_apply("jobs", rc.plan_jobs, "man_jobs"), """SELECT j.* REPLACE (CASE WHEN p.action = 'update' THEN p.status ELSE j.status END AS status, CASE WHEN p.action = 'update' THEN coalesce(p.experiment_id, j.experiment_id) ELSE j.experiment_id END AS experiment_id,
        CASE WHEN p.row_index IS NULL THEN j.updated_at ELSE :as_of END AS updated_at, CASE WHEN p.action = 'archive' THEN :as_of ELSE j.deleted_at END AS deleted_at,
        CASE WHEN p.action = 'update' THEN CASE WHEN p.attrs_json IS NOT NULL THEN '{"a.y":"z","b.x":1}' ELSE '{}' END ELSE j.attrs_json END AS attrs_json)
        FROM jobs j LEFT JOIN (SELECT * FROM plan_jobs_all WHERE error IS NULL AND action IN ('update','archive')) p ON p.existing_id = j.id
        UNION ALL BY NAME SELECT entity_id AS id, experiment_id, name, status, 0 AS code_dirty, :as_of AS created_at, :as_of AS updated_at, CASE WHEN attrs_json IS NOT NULL THEN '{"a.y":"z","b.x":1}' ELSE '{}' END AS attrs_json
        FROM plan_jobs_all WHERE error IS NULL AND action = 'insert'"""),
    "apply_updates_metrics": (_apply("metrics", rc.plan_metrics, "man_metrics"), """SELECT m.* REPLACE (CASE WHEN p.entity_id IS NULL THEN m.value ELSE TRY_CAST(p.value AS DOUBLE) END AS value, CASE WHEN p.entity_id IS NULL THEN m.updated_at ELSE :as_of END AS updated_at)
        FROM metrics m LEFT JOIN (SELECT * FROM plan_metrics_all WHERE error IS NULL AND action = 'update') p ON p.existing_id = m.id
        UNION ALL BY NAME SELECT entity_id AS id, run_id, metric_name, TRY_CAST(value AS DOUBLE) AS value, step, split, source_job_id, source_artifact_id, :as_of AS created_at, :as_of AS updated_at
        FROM plan_metrics_all WHERE error IS NULL AND action = 'insert'"""),
    "link_experiment_runs": (lambda l: rc.link_experiment_runs(l, rc.plan_runs(l, l.tables["man_runs"]).filter("error IS NULL")).select("experiment_id", "run_id"), f"""SELECT experiment_id, run_id FROM experiment_runs
        UNION SELECT m.experiment_id, {_RUN_ID} FROM plan_runs_all m WHERE m.experiment_id IN (SELECT id FROM experiments WHERE deleted_at IS NULL) AND (m.idempotency_key IS NULL OR m.idempotency_key <> 'Bad Key')
        AND (m.parent_run_id IS NULL OR (m.parent_run_id IN (SELECT id FROM runs) AND m.parent_run_id <> {_RUN_ID})) AND (m.existing_id IS NOT NULL OR m.name IS NOT NULL)"""),
    "audit_value": (_bodies, "SELECT id, CASE WHEN length(body) > 200 THEN strlen(body) END AS byte_count, CASE WHEN length(body) > 200 THEN sha256(body) END AS sha256, CASE WHEN length(body) > 200 THEN body[1:200] END AS preview FROM notes"),
    "validate_fields": (_fields, """SELECT CAST(row_index AS VARCHAR) AS key, concat_ws(';', CASE WHEN note_type = 'poem' THEN 'invalid note type ''poem''' END, CASE WHEN trim(title) = '' THEN 'note title must not be empty'
        WHEN length(title) > 120 THEN 'note title is longer than 120 characters' END, CASE WHEN strlen(body) > 65536 THEN 'note body is larger than 65536 bytes' END) AS errors FROM man_notes
        UNION ALL SELECT experiment_id || '/' || tag, CASE WHEN length(tag) = 9 THEN 'tag cannot contain whitespace' ELSE '' END FROM experiment_tags
        UNION ALL SELECT id, CASE WHEN idempotency_key LIKE '%7' THEN 'malformed idempotency key' ELSE '' END FROM experiments WHERE idempotency_key IS NOT NULL"""),
    "validate_retry_graph": (rc.validate_retry_graph, """SELECT id AS job_id, 'a job cannot retry itself' AS error FROM live_jobs WHERE retry_of = id UNION ALL
        SELECT id, 'retry target is not an active job' FROM live_jobs WHERE retry_of NOT IN (SELECT id FROM live_jobs) UNION ALL
        SELECT j.id, 'retry lineage would form a cycle' FROM live_jobs j WHERE j.retry_of <> j.id AND EXISTS (FROM retry_walk w WHERE w.root = j.id AND w.node = j.retry_of)"""),
    "plan_reference_errors": (_references, """SELECT 'job_runs' AS section, CAST(m.row_index AS VARCHAR) AS row_index, 'run_id names no row of runs' AS error FROM man_edges m
        WHERE m.job_id IS NOT NULL AND m.run_id NOT IN (SELECT id FROM runs)
        UNION ALL SELECT 'metrics', CAST(row_index AS VARCHAR), 'run_id names no row of runs' FROM man_metrics WHERE row_index%7=3 AND value <> 'oops'
        UNION ALL SELECT 'metrics', CAST(row_index AS VARCHAR), 'source_job_id names no row of jobs' FROM man_metrics WHERE row_index%11=5 AND value <> 'oops'
        UNION ALL SELECT 'jobs', CAST(row_index AS VARCHAR), 'run_id names no row of runs' FROM plan_j WHERE row_index%13=1 AND error IS NULL AND op = 'upsert'
        UNION ALL SELECT 'jobs', CAST(row_index AS VARCHAR), 'retry_of names no row of jobs' FROM plan_j WHERE row_index%17=2 AND error IS NULL AND op = 'upsert'"""),
    "plan_unique_errors": (_uniques, """SELECT 'jobs' AS section, CAST(m.row_index AS VARCHAR) AS row_index, 'external_system/external_id is taken by an active row' AS error FROM moves m
        WHERE m.ext IN (SELECT external_id FROM jobs WHERE deleted_at IS NULL AND external_system = 'sched' AND external_id IS NOT NULL AND id NOT IN (SELECT id FROM moves))
        UNION ALL SELECT 'jobs', CAST(min(row_index) AS VARCHAR), 'external_system/external_id is given to several rows' FROM moves GROUP BY ext HAVING count(*) > 1 AND NOT bool_and(fresh)"""),
    "plan_retry_errors": (_retries, """SELECT id AS job_id, 'a job cannot retry itself' AS error FROM retry_said WHERE retry_of = id
        UNION ALL SELECT id, 'retry target is not an active job' FROM jobs_then WHERE retry_of NOT IN (SELECT id FROM jobs_then) AND (said OR retry_of IN (FROM retry_gone))
        UNION ALL SELECT DISTINCT root, 'retry lineage would form a cycle' FROM retry_climb WHERE node = root AND said"""),
    "upsert_keep_existing": (_upsert, """SELECT id, idempotency_key FROM experiments UNION ALL SELECT 'up_' || id, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 4 = 0 THEN idempotency_key ELSE 'fresh-' || id END FROM experiments e
        WHERE CAST(substr(id, 5) AS BIGINT) % 4 <> 0 OR NOT EXISTS (FROM experiments x WHERE x.deleted_at IS NULL AND x.idempotency_key = e.idempotency_key)"""),
}
