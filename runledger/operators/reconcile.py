"""Manifest upsert as set-based plan and apply.

``plan`` compares manifest sections with the ledger and yields operations and
errors; ``apply_plan`` turns the operations into new table DataFrames plus the
event and operation log.  All or nothing: any error row stops the apply.

Manifest rows carry ``row_index`` (input order), optional ``op`` and ``errata``,
and text fields.  A NULL field is "not given"; where explicit nulls matter, an
array column ``_present`` lists the given keys.

A manifest is usually small against the ledger, so look-ups join the ledger with
the manifest's keys (broadcast when the optimizer sees it is small) and shuffle
only what matched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import validate as v
from runledger.functions.attrs import attr_map, canonical_object, is_json_object, merge_objects
from runledger.ledger import Ledger, conform, unique_key
from runledger.lineage import CODEC, cut
from runledger.operators import integrity
from runledger.operators.graph import cycle_members, retry_roots
from runledger.operators.ownership import left_by_key, owner_experiments, union_all

# Fixed orders of the operation log.
SECTION_RANK = {"runs": 0, "jobs": 1, "job_runs": 2, "artifacts": 3, "metrics": 4, "notes": 5, "validations": 6,
                "custom_attributes": 7, "sync_events": 8}
ACTION_RANK = {"insert": 0, "errata_replace": 1, "update": 2, "sync_event": 3, "noop": 4, "archive": 5}
ARCHIVABLE = {"runs", "jobs", "job_runs", "artifacts", "metrics", "notes", "validations"}
NO_ERRATA = {"jobs", "job_runs", "metrics"}
AUDIT_PREVIEW_CHARS = 200

# The fields of manifest rows, and those of them that a diff compares.
MANIFEST_FIELDS = {
    "runs": ["id", "name", "description", "status", "external_system", "external_id", "parent_run_id", "experiment_id", "idempotency_key", "kind", "attrs_json"],
    "jobs": ["id", "experiment_id", "run_id", "name", "status", "command", "launcher", "external_system", "external_id", "failure_reason", "started_at",
             "finished_at", "retry_of", "attrs_json"],
    "job_runs": ["job_id", "run_id", "role", "status", "started_at", "finished_at", "failure_reason", "attrs_json"],
    "artifacts": ["id", "run_id", "job_id", "experiment_id", "type", "uri", "content_hash", "attrs_json"],
    "metrics": ["id", "run_id", "metric_name", "value", "step", "split", "source_job_id", "source_artifact_id"],
    "notes": ["id", "entity_type", "entity_id", "note_type", "status", "title", "body", "body_format", "author", "attrs_json"],
    "validations": ["id", "entity_type", "entity_id", "check_name", "status", "expected_value", "measured_value", "details_json", "source_artifact_id",
                    "source_job_id", "session_id", "attrs_json"],
    "custom_attributes": ["entity_type", "entity_id", "attrs_json"],
    "sync_events": ["id", "target_system", "target_identifier", "status", "run_id", "job_id", "error_message", "idempotency_key", "origin",
                    "source_entity_type", "source_entity_id", "target_field", "payload_summary_json", "attrs_json"],
}
DIFF_FIELDS = {
    "runs": ["experiment_id", "name", "description", "status", "kind", "idempotency_key", "external_system", "external_id", "parent_run_id", "attrs_json"],
    "jobs": ["experiment_id", "run_id", "name", "status", "command", "launcher", "external_system", "external_id", "retry_of", "failure_reason", "started_at",
             "finished_at", "attrs_json"],
    "job_runs": ["status", "started_at", "finished_at", "failure_reason", "attrs_json"],
    "artifacts": ["experiment_id", "run_id", "job_id", "type", "uri", "content_hash", "attrs_json"],
    "metrics": ["value"],
    "notes": ["status", "title", "body", "body_format", "author", "attrs_json"],
    "validations": ["entity_type", "entity_id", "check_name", "status", "expected_value", "measured_value", "source_artifact_id", "source_job_id",
                    "details_json", "attrs_json"],
}
ID_PREFIX = {"runs": "run", "jobs": "job", "artifacts": "art", "metrics": "met", "notes": "note", "validations": "val", "sync_events": "sync"}
JSON_FIELDS = {"attrs_json": "attrs", "details_json": "details"}


class ReconcileError(ValueError):
    """The manifest has error rows; nothing was applied."""


def key_of(column: str) -> str:
    return JSON_FIELDS.get(column, column)


def given(df: DataFrame, column: str) -> Column:
    """Whether a manifest row names the field at all."""
    if "_present" in df.columns:
        return F.coalesce(F.array_contains("_present", key_of(column)), F.col(column).isNotNull())
    return F.col(column).isNotNull()


def normalize(section: str, df: DataFrame) -> DataFrame:
    """All manifest columns as text, with row_index, op and errata filled in."""
    types = dict(df.dtypes)
    cols = []
    for c in MANIFEST_FIELDS[section]:
        source = c if c in types else "name" if (section, c) == ("metrics", "metric_name") and "name" in types else None
        if source is None:
            cols.append(F.lit(None).cast("string").alias(c))
        elif types[source].startswith("timestamp"):
            cols.append(F.date_format(source, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c))
        elif section == "metrics" and c == "metric_name" and "name" in types and source == c:
            cols.append(F.coalesce(F.nullif(c, F.lit("")), "name").alias(c))
        else:
            cols.append(F.col(source).cast("string").alias(c))
    op = F.coalesce(F.col("op"), F.lit("upsert")) if "op" in types else F.lit("upsert")
    errata = F.coalesce(F.col("errata").cast("boolean"), F.lit(False)) if "errata" in types else F.lit(False)
    keep = [F.col("_present")] if "_present" in types else []
    return df.select("row_index", op.alias("op"), errata.alias("errata"), *cols, *keep)


def dedupe_external(section: str, rows: DataFrame) -> DataFrame:
    """Fold runs or jobs without id that share an external id: later given fields win, the first position stays."""
    folded = F.nullif("id", F.lit("")).isNull() & (F.col("external_system") != "") & (F.col("external_id") != "")
    fields = MANIFEST_FIELDS[section]
    single = rows.filter(~F.coalesce(folded, F.lit(False)))
    aggs = [F.min("row_index").alias("row_index"), F.max_by("op", "row_index").alias("op"), F.max_by("errata", "row_index").alias("errata")]
    rest = [c for c in fields if c not in ("external_system", "external_id")]
    aggs += [F.max_by(c, F.when(given(rows, c), F.col("row_index"))).alias(c) for c in rest]
    if "_present" in rows.columns:
        named = F.filter(F.array(*[F.when(F.max(given(rows, c)), F.lit(key_of(c))) for c in fields]), lambda x: x.isNotNull())
        aggs.append(named.alias("_present"))
    many = rows.filter(folded).groupBy("external_system", "external_id").agg(*aggs)
    return single.unionByName(many.select(*rows.columns))


# --- matching ------------------------------------------------------------------

def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _least_of(ledger_side: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Manifest keys with the least ledger id of each: the ledger side is one row per key before it meets the manifest's rows."""
    return keys.join(ledger_side.join(keys.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.min("existing_id").alias("existing_id")), on)


def match_existing(l: Ledger, section: str, rows: DataFrame) -> DataFrame:
    """(row_index, existing_id): the ledger row each manifest row means, by priority.

    id first (archived or not), then the section's natural key among active rows.
    Runs naming an experiment and an idempotency key never fall through to the external id.
    """
    full = l.table(section)
    live = full.filter(F.col("deleted_at").isNull())
    hits: list[DataFrame] = []

    def add(priority: int, ledger_side: DataFrame, on: list[str], where: Column | None = None) -> None:
        side = rows if where is None else rows.filter(where)
        keys = side.select("row_index", *[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
        hits.append(_least_of(ledger_side, keys, [f"k{i}" for i in range(len(on))]).select("row_index", F.lit(priority).alias("priority"), "existing_id"))

    def side(df: DataFrame, *cols: Column) -> DataFrame:
        return df.select(F.col("id").alias("existing_id"), *[c.alias(f"k{i}") for i, c in enumerate(cols)])

    def natural(priority: int, where: Column | None = None) -> None:
        keys = (rows if where is None else rows.filter(where)).select("row_index", *unique_key(section))
        on = [c for c in keys.columns if c != "row_index"]
        keys = keys.dropna(subset=on)
        there = l.holders(section, keys).withColumnRenamed("id", "existing_id")
        hits.append(_least_of(there, keys, on).select("row_index", F.lit(priority).alias("priority"), "existing_id"))

    named = rows.filter(F.col("id") != "")
    add(0, side(l.rows_of(section, named.select("id")), F.col("id")), ["id"], F.col("id") != "")
    if section == "runs":
        keyed = (F.col("experiment_id") != "") & (F.col("idempotency_key") != "")
        add(1, side(live, F.col("experiment_id"), F.col("idempotency_key")), ["experiment_id", "idempotency_key"], keyed)
        natural(2, ~F.coalesce(keyed, F.lit(False)))
    elif section in schemas.UNIQUE_KEYS:
        natural(1)
    best = union_all(hits).groupBy("row_index").agg(F.min(F.struct("priority", "existing_id")).alias("m"))
    return best.select("row_index", F.col("m.existing_id").alias("existing_id"))


# --- shared pieces of the planners ------------------------------------------------

def apply_number(l: Ledger) -> int:
    """How many manifests the ledger has taken so far; it tells apart two that are applied at one reference time."""
    return l.once("apply_number", lambda: l.table("reconcile_events").count())


def new_id(section: str, l: Ledger) -> Column:
    return F.concat(F.lit(ID_PREFIX[section] + "_"), F.substring(
        F.sha2(F.concat_ws("|", F.lit(section), F.lit(str(l.as_of)), F.lit(str(apply_number(l))), F.col("row_index").cast("string")), 256), 1, 26))


def _op_errors(section: str) -> list[Column]:
    allowed = ["upsert", "archive"] if section in ARCHIVABLE else ["upsert"]
    out = [F.when(F.col("op") == "delete", "delete is not supported; use archive"), F.when(~F.col("op").isin(allowed), F.concat(F.lit("invalid op for " + section + ": "), "op"))]
    if section in NO_ERRATA:
        out.append(F.when(F.col("errata"), f"{section} do not support errata"))
    return out


def _typed(section: str, column: str) -> Column:
    kind = {n: k for n, k, _ in schemas.columns(section)}[column]
    if kind == "ts":
        return v.parse_utc_z(column)
    if kind == "d":
        return v.python_float(F.col(column))
    return F.col(column)


def _pair(section: str, column: str, old: Column, new: Column) -> Column:
    """Diff entry ``"field":[old,new]`` as JSON text."""
    if column in JSON_FIELDS:
        body = F.concat(F.lit("["), canonical_object(old), F.lit(","), canonical_object(new), F.lit("]"))
    else:
        as_text = F.to_json(F.array(old, new), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "ignoreNullFields": "false"})
        body = as_text
    return F.concat(F.lit(f'"{key_of(column)}":'), body)


def row_diff(section: str, df: DataFrame, extra: dict[str, Column] | None = None) -> Column:
    """JSON object of changed given fields; ``{}`` when nothing changed.

    Attributes compare as parsed objects and default to the existing ones.
    """
    entries: dict[str, Column] = {}
    for c in DIFF_FIELDS[section]:
        old = F.col(f"old.{c}")
        new = _typed(section, c)
        if c in JSON_FIELDS:
            changed = given(df, c) & (canonical_object(old) != canonical_object(F.col(c)))
        else:
            changed = given(df, c) & ~old.eqNullSafe(new)
        entries[c] = F.when(changed, _pair(section, c, old, new))
    for c, cond_entry in (extra or {}).items():
        entries[c] = F.coalesce(cond_entry, entries.get(c, F.lit(None).cast("string")))
    ordered = F.filter(F.array(*[entries[c] for c in sorted(entries, key=key_of)]), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}"))


def audit_text(column: Column) -> Column:
    """Long note bodies are logged as size, hash and preview, as JSON text."""
    long = F.to_json(F.struct(F.octet_length(column).alias("byte_count"), F.substring(column, 1, AUDIT_PREVIEW_CHARS).alias("preview"), F.sha2(column, 256).alias("sha256")))
    short = F.to_json(F.array(column))
    return F.when(F.length(column) > AUDIT_PREVIEW_CHARS, long).otherwise(F.substr(short, F.lit(2), F.length(short) - 2))


def input_json(section: str, df: DataFrame) -> Column:
    """The manifest row as logged: given fields in key order."""
    entries = {}
    for c in MANIFEST_FIELDS[section]:
        text = F.to_json(F.array(F.col(c)))
        value = (canonical_object(F.col(c)) if c in JSON_FIELDS else audit_text(F.col(c)) if c == "body" else F.substr(text, F.lit(2), F.length(text) - 2))
        entries[key_of(c)] = F.when(given(df, c), F.concat(F.lit(f'"{key_of(c)}":'), F.coalesce(value, F.lit("null"))))
    ordered = F.filter(F.array(*[entries[k] for k in sorted(entries)]), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(ordered, ","), F.lit("}"))


def _with_existing(l: Ledger, section: str, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Manifest rows with the ledger row they mean; ``more``: the same rows with further columns, which the match does not need."""
    matched = cut(match_existing(l, section, rows), "matched")
    full = l.table(section)
    old = l.rows_of(section, matched.select(F.col("existing_id").alias("id"))).select(F.col("id").alias("existing_id"), F.struct(*full.columns).alias("old"))
    return (rows if more is None else more).join(matched.join(old, "existing_id"), "row_index", "left")


def _experiment_state(l: Ledger, df: DataFrame, column: str = "experiment_id") -> DataFrame:
    state = l.table("experiments").select(F.col("id").alias(column), F.when(F.col("deleted_at").isNull(), "active").otherwise("archived").alias("experiment_state"))
    return left_by_key(df, state, [column], ["row_index"])


def _experiment_error(allow_archived: Column | None = None) -> list[Column]:
    allowed = F.lit(False) if allow_archived is None else allow_archived
    return [F.when(F.col("experiment_id").isNotNull() & F.col("experiment_state").isNull(), "experiment not found"),
            F.when((F.col("experiment_state") == "archived") & ~allowed, "experiment is archived and cannot be reconciled")]


def _known(l: Ledger, table: str, df: DataFrame, column: str, flag_name: str, active: bool = False) -> DataFrame:
    src = l.rows_of(table, df.select(F.col(column).alias("id")).filter("id IS NOT NULL"))
    src = src.filter(F.col("deleted_at").isNull()) if active else src
    return left_by_key(df, src.select(F.col("id").alias(column), F.lit(True).alias(flag_name)), [column], ["row_index"])


def _row_owners(l: Ledger, triples: DataFrame) -> DataFrame:
    """(row_index, side, resolved_id): experiments owning each (row, side) owner triple.

    Both sides (the manifest's target and the existing row) are resolved together, and
    the result is stored: several checks read it.
    """
    owned = F.coalesce("experiment_id", "run_id", "job_id").isNotNull()  # rows without any owner would all meet on one key and resolve to nothing
    keys = cut(triples.filter(owned).select("row_index", "side", "experiment_id", "run_id", "job_id"), "owner-keys")
    owners = owner_experiments(l, keys.select("experiment_id", "run_id", "job_id").distinct(), narrow=True)
    on = [keys[c].eqNullSafe(owners[f"owner_{c}"]) for c in ("experiment_id", "run_id", "job_id")]
    return cut(keys.join(owners, on).select("row_index", "side", "resolved_id"), "row-owners")


def _archived_side(l: Ledger, owners: DataFrame, side: str) -> DataFrame:
    """Rows whose owners on that side include an archived experiment."""
    gone = l.table("experiments").filter(F.col("deleted_at").isNotNull()).select(F.col("id").alias("resolved_id"))
    return owners.filter(F.col("side") == side).join(gone, "resolved_id", "left_semi")


def _entity_owners(l: Ledger, df: DataFrame) -> DataFrame:
    """Owners of the targets of notes or validations, for the manifest row and the existing row."""
    now = df.select("row_index", F.lit("new").alias("side"), "entity_type", "entity_id")
    before = df.filter(F.col("existing_id").isNotNull()).select(
        "row_index", F.lit("old").alias("side"), F.col("old.entity_type").alias("entity_type"), F.col("old.entity_id").alias("entity_id"))
    return _row_owners(l, _entity_triples(l, now.unionByName(before), "entity_type", "entity_id"))


def _entity_triples(l: Ledger, df: DataFrame, type_col: str, id_col: str) -> DataFrame:
    """(row_index, side, experiment_id, run_id, job_id) owners of polymorphic targets."""
    none = F.lit(None).cast("string")
    def pick(kind): return F.when(F.col(type_col) == kind, F.col(id_col)).otherwise(none)  # noqa: E704
    simple = df.filter(F.col(type_col).isin("experiment", "run", "job")).select(
        "row_index", "side", pick("experiment").alias("experiment_id"), pick("run").alias("run_id"), pick("job").alias("job_id"))
    art = df.filter(F.col(type_col) == "artifact").select("row_index", "side", F.col(id_col).alias("id")).join(
        l.table("artifacts").select("id", "experiment_id", "run_id", "job_id"), "id").select("row_index", "side", "experiment_id", "run_id", "job_id")
    met = df.filter(F.col(type_col) == "metric").select("row_index", "side", F.col(id_col).alias("id")).join(
        l.table("metrics").select("id", "run_id"), "id").select("row_index", "side", none.alias("experiment_id"), "run_id", none.alias("job_id"))
    return simple.unionByName(art).unionByName(met)


def _flag_rows(df: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    return df.join(rows.select("row_index").distinct().withColumn(name, F.lit(True)), "row_index", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _target_state(l: Ledger, df: DataFrame, type_col: str, id_col: str) -> DataFrame:
    """Adds target_state: active, archived or NULL (missing) of a polymorphic target."""
    parts = []
    for kind, table in schemas.ENTITY_TABLE.items():
        t = l.table(table).select(F.col("id").alias("_tid"), F.when(F.col("deleted_at").isNull(), "active").otherwise("archived").alias("target_state"))
        sub = df.filter(F.col(type_col) == kind)
        parts.append(sub.join(t, sub[id_col] == t["_tid"], "left").drop("_tid"))
    rest = df.filter(~F.coalesce(F.col(type_col).isin(list(schemas.ENTITY_TABLE)), F.lit(False))).withColumn("target_state", F.lit(None).cast("string"))
    return union_all([*parts, rest])


PLAN_SUFFIX = ["row_index", "action", "target_id", "existing_id", "diff_json", "input_json", "error", "op", "errata", "old"]


def _finish(section: str, df: DataFrame, checks: list[Column], target_id: Column, extra_diff: dict[str, Column] | None = None, errata_replace: Column | None = None) -> DataFrame:
    """Common tail of a section plan: error, diff, action, log texts."""
    exists = F.col("existing_id").isNotNull()
    archive = F.col("op") == "archive"
    error = F.coalesce(*_op_errors(section), F.when(archive & ~exists, "row to archive not found"), F.when(~archive, F.coalesce(*checks)))
    diff = row_diff(section, df, extra_diff)
    replace = F.coalesce(errata_replace, F.lit(False)) if errata_replace is not None else F.lit(False)
    action = (F.when(archive, F.when(F.col("old.deleted_at").isNotNull(), "noop").otherwise("archive"))
              .when(replace, "errata_replace").when(~exists, "insert").when(diff == "{}", "noop").otherwise("update"))
    out = df.withColumn("error", error).withColumn("action", action).withColumn("target_id", F.when(archive, F.col("existing_id")).otherwise(target_id))
    shown = (F.when(F.col("action") == "update", diff)
             .when(F.col("action") == "errata_replace", F.concat(F.lit('{"replaces":'), F.to_json(F.array("existing_id", "target_id")), F.lit("}"))).otherwise("{}"))
    return out.withColumn("diff_json", shown).withColumn("input_json", input_json(section, df)).select(
        *PLAN_SUFFIX, *[c for c in MANIFEST_FIELDS[section] if c != "id"], *(["_present"] if "_present" in df.columns else []))


# --- section planners ------------------------------------------------------------

def plan_runs(l: Ledger, manifest: DataFrame, experiment_id: str | None = None) -> DataFrame:
    rows = normalize("runs", manifest)
    rows = dedupe_external("runs", rows)
    if experiment_id:
        rows = rows.withColumn("experiment_id", F.coalesce("experiment_id", F.lit(experiment_id)))
    df = _experiment_state(l, _with_existing(l, "runs", rows))
    df = _known(l, "runs", df, "parent_run_id", "parent_known")
    links = l.table("experiment_runs").select("experiment_id", F.col("run_id").alias("existing_id"), F.lit(True).alias("linked"))
    df = left_by_key(df, links, ["experiment_id", "existing_id"], ["row_index"])
    rid = F.coalesce("existing_id", F.nullif("id", F.lit("")), new_id("runs", l))
    checks = [
        v.choice(F.coalesce("status", F.lit("active")), schemas.RUN_STATUSES, "run status"), v.choice(F.coalesce("kind", F.lit("datapoint")), schemas.RUN_KINDS, "run kind"),
        v.idempotency_key("idempotency_key"), F.when(F.col("parent_run_id") == rid, "parent run cannot be the run itself"),
        F.when(F.col("parent_run_id").isNotNull() & F.col("parent_known").isNull(), "parent run does not exist"), *_experiment_error(),
        F.when(F.col("existing_id").isNull() & F.nullif("name", F.lit("")).isNull(), "new runs need a name")]
    unlinked = F.when(F.col("experiment_id").isNotNull() & F.col("existing_id").isNotNull() & F.col("linked").isNull(),
                      F.concat(F.lit('"experiment_id":[null,'), F.to_json(F.array("experiment_id")).substr(F.lit(2), F.length("experiment_id") + 2), F.lit("]")))
    return _finish("runs", df, checks, rid, {"experiment_id": unlinked})


def plan_jobs(l: Ledger, manifest: DataFrame, experiment_id: str | None = None) -> DataFrame:
    rows = dedupe_external("jobs", normalize("jobs", manifest))
    if experiment_id:
        rows = rows.withColumn("experiment_id", F.coalesce("experiment_id", F.lit(experiment_id)))
    # looked up on the manifest's own rows: beside the ledger's rows they would be sent by experiment too, and most name none
    named = F.col("experiment_id").isNotNull()
    state = _experiment_state(l, rows.filter(named))
    df = _with_existing(l, "jobs", rows, state.unionByName(rows.filter(~named).withColumn("experiment_state", F.lit(None).cast("string"))))
    checks = [v.choice(F.coalesce("status", F.lit("planned")), schemas.JOB_STATUSES, "job status"), v.utc_z("started_at"), v.utc_z("finished_at"), *_experiment_error()]
    return _finish("jobs", df, checks, F.coalesce("existing_id", F.nullif("id", F.lit("")), new_id("jobs", l)))


def plan_job_runs(l: Ledger, manifest: DataFrame) -> DataFrame:
    rows = normalize("job_runs", manifest)
    full = l.table("job_runs")
    keys = rows.select("job_id", "run_id").distinct()
    old = l.rows_of("job_runs", keys.select("job_id")).join(keys, ["job_id", "run_id"], "left_semi").select("job_id", "run_id", F.concat_ws(":", "job_id", "run_id").alias("existing_id"), F.struct(*full.columns).alias("old"))
    df = rows.join(old, ["job_id", "run_id"], "left").withColumn("id", F.lit(None).cast("string"))
    role, status = F.coalesce("role", F.lit("other")), F.coalesce("status", F.lit("planned"))
    checks = [v.required("job_id"), v.required("run_id"), v.choice(role, schemas.JOB_RUN_ROLES, "job-run role"), v.choice(status, schemas.JOB_STATUSES, "job-run status"),
              v.utc_z("started_at"), v.utc_z("finished_at"), F.when(F.col("existing_id").isNotNull() & (F.col("old.role") != role), "job-run role cannot change")]
    df = df.withColumn("role", role).withColumn("status", status)
    revived = F.when(F.col("old.deleted_at").isNotNull(), F.concat(F.lit('"deleted_at":["'), F.date_format("old.deleted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('",null]')))
    return _finish("job_runs", df, checks, F.concat_ws(":", "job_id", "run_id"), {"deleted_at": revived})


def _errata_attrs(l: Ledger, attrs: Column, session_id: str | None, replaces: Column | None = None) -> Column:
    extra = [F.concat(F.lit(f'"{schemas.ATTR_ERRATUM}":true')), F.lit(f'"{schemas.ATTR_ERRATUM_AT}":"{l.as_of.isoformat()}Z"')]
    if session_id:
        extra.append(F.lit(f'"{schemas.ATTR_ERRATUM_SESSION}":"{session_id}"'))
    if replaces is not None:
        extra.append(F.when(replaces.isNotNull(), F.concat(F.lit(f'"{schemas.ATTR_REPLACES}":"'), replaces, F.lit('"'))))
    return merge_objects(F.coalesce(attrs, F.lit("{}")), F.concat(F.lit("{"), F.concat_ws(",", *extra), F.lit("}")))


def plan_artifacts(l: Ledger, manifest: DataFrame, experiment_id: str | None = None, session_id: str | None = None) -> DataFrame:
    rows = normalize("artifacts", manifest).withColumn("content_hash", F.lower("content_hash"))
    if experiment_id:
        rows = rows.withColumn("experiment_id", F.coalesce("experiment_id", F.lit(experiment_id)))
    df = _experiment_state(l, cut(_with_existing(l, "artifacts", rows), "plan-artifacts"))
    owner = ["experiment_id", "run_id", "job_id"]
    before = df.filter(F.col("errata") & F.col("existing_id").isNotNull()).select("row_index", F.lit("old").alias("side"), *[F.col(f"old.{c}").alias(c) for c in owner])
    owners = _row_owners(l, df.select("row_index", F.lit("new").alias("side"), *owner).unionByName(before))
    df = _flag_rows(df, _archived_side(l, owners, "new"), "to_archived")
    # Errata may not move a URI between unrelated experiments: some owner must be shared when both sides have owners.
    sides = owners.groupBy("row_index", "resolved_id").agg(F.count_distinct("side").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    foreign = sides.groupBy("row_index").agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n = 1 AND lo <> hi")
    df = _flag_rows(df, foreign, "foreign")
    fresh = new_id("artifacts", l)
    wanted = F.nullif("id", F.lit(""))
    aid = F.when(F.col("errata"), F.when(wanted.isNull() | wanted.eqNullSafe(F.col("existing_id")), fresh).otherwise(wanted)).otherwise(F.coalesce("existing_id", wanted, fresh))
    checks = [v.required("type"), v.choice("type", schemas.ARTIFACT_TYPES, "artifact type"), v.content_hash("content_hash"), *_experiment_error(F.col("errata")),
              F.when(F.col("to_archived") & ~F.col("errata"), "artifact targets an archived experiment and needs errata"),
              F.when(F.col("existing_id").isNull() & F.col("uri").isNull(), "new artifacts need a uri"),
              F.when(F.col("foreign"), "artifact URI already belongs to other experiments")]
    df = df.withColumn("attrs_json", F.when(F.col("errata") & (F.col("op") == "upsert"), _errata_attrs(l, F.col("attrs_json"), session_id, F.col("existing_id"))).otherwise(F.col("attrs_json")))
    return _finish("artifacts", df, checks, aid, errata_replace=F.col("errata") & F.col("existing_id").isNotNull())


def plan_metrics(l: Ledger, manifest: DataFrame) -> DataFrame:
    rows = normalize("metrics", manifest)
    df = _with_existing(l, "metrics", rows)
    number = v.python_float(F.col("value"))
    checks = [v.required("run_id"), v.required("metric_name"), F.when(F.col("value").isNull(), "metric rows need a value"), F.when(number.isNull(), "metric value must be numeric")]
    return _finish("metrics", df, checks, F.coalesce("existing_id", F.nullif("id", F.lit("")), new_id("metrics", l)))


def plan_notes(l: Ledger, manifest: DataFrame, session_id: str | None = None) -> DataFrame:
    rows = normalize("notes", manifest).withColumn("title", F.trim("title"))
    df = cut(_with_existing(l, "notes", rows), "plan-notes")
    owners = _entity_owners(l, df)
    df = _flag_rows(df, _archived_side(l, owners, "new"), "to_archived")
    df = _flag_rows(df, _archived_side(l, owners, "old"), "old_archived")
    insert = F.col("existing_id").isNull()
    checks = [v.required("entity_type"), v.required("note_type"), v.choice("entity_type", schemas.ENTITY_TYPES, "entity type"),
              F.when(F.col("to_archived") & ~F.col("errata"), "note targets an archived experiment and needs errata"),
              v.choice("note_type", schemas.NOTE_TYPES, "note type"), v.choice(F.coalesce("status", F.lit("open")), schemas.NOTE_STATUSES, "note status"), v.note_title("title"),
              v.note_body("body"), F.when(insert & F.col("body").isNull(), "new notes need a body"), v.choice("body_format", schemas.NOTE_BODY_FORMATS, "note body format"),
              F.when(~insert & F.col("old_archived"), "notes of archived experiments cannot be updated")]
    df = df.withColumn("body_format", F.coalesce("body_format", F.when(insert, F.lit("markdown")))).withColumn(
        "attrs_json", F.when(F.col("errata") & (F.col("op") == "upsert"), _errata_attrs(l, F.col("attrs_json"), session_id)).otherwise(F.col("attrs_json")))
    return _finish("notes", df, checks, F.coalesce("existing_id", F.nullif("id", F.lit("")), new_id("notes", l)))


def plan_validations(l: Ledger, manifest: DataFrame, session_id: str | None = None) -> DataFrame:
    rows = normalize("validations", manifest)
    base = cut(_with_existing(l, "validations", rows), "plan-validations")
    owners = _entity_owners(l, base)
    df = _target_state(l, base, "entity_type", "entity_id")
    df = _known(l, "artifacts", df, "source_artifact_id", "artifact_ok", active=True)
    df = _known(l, "jobs", df, "source_job_id", "job_ok", active=True)
    df = _flag_rows(df, _archived_side(l, owners, "new"), "to_archived")
    df = _flag_rows(df, _archived_side(l, owners, "old"), "old_archived")
    replace = F.col("errata") & F.col("existing_id").isNotNull()
    checks = [v.required("entity_type"), v.choice("entity_type", schemas.ENTITY_TYPES, "entity type"), v.required("status"), v.choice("status", schemas.VALIDATION_STATUSES, "validation status"),
              v.required("entity_id"), v.required("check_name"), F.when(F.col("target_state").isNull(), "validation entity does not exist"),
              F.when(F.col("to_archived") & ~F.col("errata"), "validation targets an archived experiment and needs errata"),
              F.when((F.col("target_state") == "archived") & ~F.col("errata"), "validation entity does not exist"),
              F.when(F.col("details_json").isNotNull() & ~is_json_object(F.col("details_json")), "validation details must be an object"),
              F.when(F.col("source_artifact_id").isNotNull() & F.col("artifact_ok").isNull(), "source artifact does not exist"),
              F.when(F.col("source_job_id").isNotNull() & F.col("job_ok").isNull(), "source job does not exist"),
              F.when(F.col("existing_id").isNotNull() & ~replace & F.col("old_archived"), "validations of archived experiments cannot be updated")]
    df = df.withColumn("details_json", F.coalesce("details_json", F.lit("{}"))).withColumn(
        "attrs_json", F.when(F.col("errata") & (F.col("op") == "upsert"), _errata_attrs(l, F.col("attrs_json"), session_id, F.col("existing_id"))).otherwise(F.col("attrs_json")))
    if "_present" in df.columns:
        df = df.withColumn("_present", F.array_union("_present", F.array(F.lit("details"))))
    fresh, wanted = new_id("validations", l), F.nullif("id", F.lit(""))
    vid = F.when(F.col("errata"), F.when(wanted.isNull() | wanted.eqNullSafe(F.col("existing_id")), fresh).otherwise(wanted)).otherwise(F.coalesce("existing_id", wanted, fresh))
    return _finish("validations", df, checks, vid, errata_replace=replace)


def plan_custom_attributes(l: Ledger, manifest: DataFrame) -> DataFrame:
    rows = normalize("custom_attributes", manifest)
    parts = []
    for kind, table in schemas.ENTITY_TABLE.items():
        df = l.table(table)
        current = F.col("attrs_json") if "attrs_json" in df.columns else F.lit("{}")
        t = df.select(F.col("id").alias("_tid"), current.alias("current"), F.lit(True).alias("found"))
        sub = rows.filter(F.col("entity_type") == kind)
        parts.append(sub.join(t, sub["entity_id"] == t["_tid"], "left").drop("_tid"))
    rest = rows.filter(~F.coalesce(F.col("entity_type").isin(list(schemas.ENTITY_TABLE)), F.lit(False))).withColumn("current", F.lit(None).cast("string")).withColumn("found", F.lit(None).cast("boolean"))
    df = union_all([*parts, rest])
    merged, before = merge_objects(F.col("current"), F.col("attrs_json")), canonical_object(F.col("current"))
    error = F.coalesce(*_op_errors("custom_attributes"), v.required("entity_type"), v.choice("entity_type", schemas.ENTITY_TYPES, "entity type"),
                       F.when(F.col("found").isNull(), "custom attribute target not found"),
                       F.when(F.col("attrs_json").isNull() | ~is_json_object(F.col("attrs_json")), "custom attributes need an attrs object"), v.attr_keys("attrs_json"),
                       F.when(F.col("entity_type") == "metric", "metrics carry no attributes"))
    return df.select("row_index", F.when(merged == before, "noop").otherwise("update").alias("action"), F.col("entity_id").alias("target_id"), F.col("entity_id").alias("existing_id"),
                     F.when(error.isNotNull() | (merged == before), "{}").otherwise(F.concat(F.lit('{"attrs":['), before, F.lit(","), merged, F.lit("]}"))).alias("diff_json"),
                     input_json("custom_attributes", rows).alias("input_json"), error.alias("error"), "op", "errata", "entity_type", "entity_id", "attrs_json")


def plan_sync_events(l: Ledger, manifest: DataFrame) -> DataFrame:
    given_cols = set(manifest.columns)
    rows = normalize("sync_events", manifest)
    provenance = ["source_entity_type", "source_entity_id", "target_field", "payload_summary_json"]
    keys = rows.filter(F.col("idempotency_key") != "").select("row_index", "target_system", _blank("target_identifier").alias("_ident"), "idempotency_key")
    there = l.table("sync_events").filter((F.col("origin") == "manifest") & F.col("idempotency_key").isNotNull()).select(
        "target_system", _blank("target_identifier").alias("_ident"), "idempotency_key", F.col("id").alias("existing_id"))
    known = _least_of(there, keys, ["target_system", "_ident", "idempotency_key"]).select("row_index", "existing_id")
    df = rows.join(known, "row_index", "left")
    extra_key = F.lit(False)
    for c in provenance:
        if c in given_cols:
            extra_key = extra_key | F.col(c).isNotNull()
    error = F.coalesce(*_op_errors("sync_events"), v.required("target_system"), v.required("status"), F.when(F.col("origin") == "writeback", "manifests cannot add writeback events"),
                       F.when(extra_key, "manifests cannot set writeback provenance"), v.choice("status", schemas.SYNC_STATUSES, "sync event status"),
                       F.when(F.col("attrs_json").isNotNull() & ~is_json_object(F.col("attrs_json")), "sync event attrs must be an object"), v.attr_keys("attrs_json"))
    sid = F.coalesce("existing_id", F.nullif("id", F.lit("")), new_id("sync_events", l))
    return df.select("row_index", F.when(F.col("existing_id").isNotNull(), "noop").otherwise("sync_event").alias("action"), sid.alias("target_id"), "existing_id",
                     F.lit("{}").alias("diff_json"), input_json("sync_events", rows).alias("input_json"), error.alias("error"), "op", "errata",
                     *[c for c in MANIFEST_FIELDS["sync_events"] if c != "id"])


# --- the whole plan -----------------------------------------------------------------

@dataclass
class Plan:
    sections: dict[str, DataFrame]
    graph_errors: DataFrame | None
    broken: DataFrame | None = None  #: rows that would break a reference or a unique key

    @property
    def operations(self) -> DataFrame:
        return union_all([df.select(F.lit(s).alias("section"), "action", F.col("target_id").alias("entity_id"), F.col("row_index").cast("string").alias("row_index"), "input_json", "diff_json", "error")
                          for s, df in self.sections.items()])

    @property
    def errors(self) -> DataFrame:
        bad = self.operations.filter(F.col("error").isNotNull()).select("section", "row_index", "error")
        parts = [bad, *[_duplicate_errors(s, df) for s, df in self.sections.items() if s in DIFF_FIELDS]]
        if self.graph_errors is not None:
            parts.append(self.graph_errors.select(F.lit("jobs").alias("section"), F.col("job_id").alias("row_index"), "error"))
        if self.broken is not None:
            parts.append(self.broken)
        return union_all(parts)

    def counts(self) -> DataFrame:
        return count_operations(self.operations)


SELF_RETRY, NO_TARGET, RING = "a job cannot retry itself", "retry target is not an active job", "retry lineage would form a cycle"


def _duplicate_errors(section: str, df: DataFrame) -> DataFrame:
    """Inserts of one manifest that would break a uniqueness rule of the ledger."""
    fresh = df.filter(F.col("action").isin("insert", "errata_replace"))
    keys = {"metrics": ["run_id", "metric_name", "step", "split", "source_job_id", "source_artifact_id"], "artifacts": ["uri"], "validations": ["entity_type", "entity_id", "check_name"],
            "runs": ["external_system", "external_id"], "jobs": ["external_system", "external_id"]}
    parts = [fresh.groupBy("target_id").agg(F.count("*").alias("n"), F.min("row_index").alias("row_index")).filter("n > 1").select("row_index", F.lit("duplicate id in manifest").alias("error"))]
    if section in keys:
        cols = keys[section]
        whole = fresh.filter(F.col("external_system").isNotNull() & F.col("external_id").isNotNull()) if "external_id" in cols else fresh
        parts.append(whole.groupBy(*[_blank(c).alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.count("*").alias("n"), F.min("row_index").alias("row_index")).filter("n > 1").select(
            "row_index", F.lit("duplicate key in manifest").alias("error")))
    return union_all(parts).select(F.lit(section).alias("section"), F.col("row_index").cast("string").alias("row_index"), "error")


def validate_retry_graph(l: Ledger) -> DataFrame:
    """(job_id, error) of the ledger's own retry faults, whoever caused them."""
    live = l.active("jobs").select(F.col("id").alias("job_id"), "retry_of")
    linked = cut(live.filter(F.col("retry_of").isNotNull()), "retry-graph")
    wanted = linked.select(F.col("retry_of").alias("job_id")).distinct()
    there = cut(live.select("job_id").join(wanted, "job_id", "left_semi").select(F.col("job_id").alias("retry_of")), "retry-targets")
    own = linked.filter(F.col("retry_of") == F.col("job_id")).select("job_id", F.lit(SELF_RETRY).alias("error"))
    missing = linked.join(there, "retry_of", "left_anti").select("job_id", F.lit(NO_TARGET).alias("error"))
    edge = linked.filter(F.col("retry_of") != F.col("job_id")).join(there, "retry_of", "left_semi").select(F.col("job_id").alias("id"), F.col("retry_of").alias("parent"))
    ring = cycle_members(cut(edge, "retry-graph-edges")).select(F.col("id").alias("job_id"), F.lit(RING).alias("error"))
    return own.unionByName(missing).unionByName(ring)


def manifest_retry_errors(l: Ledger, job_plan: DataFrame) -> DataFrame:
    """(job_id, error) of the retry faults that a manifest's job rows would cause.  A row without retry_of clears the parent.

    A new ring holds a changed edge, and climbing from a changed edge stays inside the trees of the changed jobs and of their
    new targets; so only the edges of those trees are walked, which the ledger's tree index finds.  Faults of jobs
    the manifest leaves alone are not its own: ``validate_retry_graph`` reports them.
    """
    said = cut(job_plan.filter(F.col("error").isNull() & F.col("action").isin("insert", "update", "noop") & (F.col("op") != "archive")).groupBy(F.col("target_id").alias("job_id")).agg(
        F.max_by(F.struct("retry_of"), "row_index").alias("m")).select("job_id", F.col("m.retry_of").alias("retry_of")), "retry-said")
    gone = job_plan.filter(F.col("error").isNull() & (F.col("action") == "archive")).select(F.col("existing_id").alias("job_id")).distinct()
    said = cut(said.join(gone, "job_id", "left_anti"), "retry-said")
    live = l.active("jobs").select(F.col("id").alias("job_id"), "retry_of")
    linked = said.filter(F.col("retry_of").isNotNull())
    own = linked.filter(F.col("retry_of") == F.col("job_id")).select("job_id", F.lit(SELF_RETRY).alias("error"))
    # targets are active in the ledger and not archived here, or written here
    wanted = linked.select(F.col("retry_of").alias("job_id")).distinct()
    there = l.rows_of("jobs", wanted.select(F.col("job_id").alias("id"))).filter(F.col("deleted_at").isNull()).select(F.col("id").alias("job_id")).join(gone, "job_id", "left_anti").unionByName(said.select("job_id")).distinct()
    missing = linked.join(there.select(F.col("job_id").alias("retry_of")), "retry_of", "left_anti")
    orphaned = live.join(gone.select(F.col("job_id").alias("retry_of")), "retry_of", "left_semi").join(
        said.select("job_id").unionByName(gone), "job_id", "left_anti")
    lost = missing.unionByName(orphaned).select("job_id", F.lit(NO_TARGET).alias("error"))
    new_edges = linked.filter(F.col("retry_of") != F.col("job_id")).select(F.col("job_id").alias("id"), F.col("retry_of").alias("parent"))
    if new_edges.isEmpty():
        return own.unionByName(lost)
    index = retry_roots(l)
    ends = new_edges.select("id").unionByName(new_edges.select(F.col("parent").alias("id"))).distinct()
    trees = index.join(ends, "id", "left_semi").select("root").unionByName(ends.select(F.col("id").alias("root"))).distinct()
    kept = index.join(trees, "root", "left_semi").select("id", "parent")
    # the manifest may also name a target that was missing or archived until now
    waiting = live.join(said.select(F.col("job_id").alias("retry_of")), "retry_of", "left_semi").select(F.col("job_id").alias("id"), F.col("retry_of").alias("parent"))
    kept = kept.unionByName(waiting).distinct().join(said.select("job_id").unionByName(gone).select(F.col("job_id").alias("id")), "id", "left_anti")
    ring = cycle_members(cut(kept.unionByName(new_edges), "retry-trees"))
    caused = ring.join(ring.join(new_edges.select("id"), "id", "left_semi").select("cycle_id").distinct(), "cycle_id", "left_semi")
    return own.unionByName(lost).unionByName(caused.select(F.col("id").alias("job_id"), F.lit(RING).alias("error")))


def plan(l: Ledger, manifest: dict[str, DataFrame], experiment_id: str | None = None, session_id: str | None = None, check_graph: bool = True) -> Plan:
    """Plan all sections of a manifest.  Sections are read against the ledger, not against each other."""
    unknown = set(manifest) - set(SECTION_RANK)
    if unknown:
        raise ValueError(f"unknown manifest sections: {sorted(unknown)}")
    for section, rows in manifest.items():
        twice = rows.groupBy("row_index").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ReconcileError(f"{section}: row_index {twice[0]['row_index']} is given to several rows")
    planners: dict[str, Callable[[DataFrame], DataFrame]] = {
        "runs": lambda m: plan_runs(l, m, experiment_id), "jobs": lambda m: plan_jobs(l, m, experiment_id), "job_runs": lambda m: plan_job_runs(l, m),
        "artifacts": lambda m: plan_artifacts(l, m, experiment_id, session_id), "metrics": lambda m: plan_metrics(l, m), "notes": lambda m: plan_notes(l, m, session_id),
        "validations": lambda m: plan_validations(l, m, session_id), "custom_attributes": lambda m: plan_custom_attributes(l, m), "sync_events": lambda m: plan_sync_events(l, m)}
    sections = {s: cut(planners[s](manifest[s]), f"plan-{s}", CODEC) for s in SECTION_RANK if s in manifest}
    graph = cut(manifest_retry_errors(l, sections["jobs"]), "plan-retries") if check_graph and "jobs" in sections else None
    broken = cut(union_all([integrity.reference_errors(l, sections), integrity.unique_errors(l, sections)]), "plan-broken")
    return Plan(sections, graph, broken)


def count_operations(operations: DataFrame) -> DataFrame:
    """(section, action, n); an errata replacement counts as an insert and an archive."""
    acts = F.when(F.col("action") == "errata_replace", F.array(F.lit("insert"), F.lit("archive"))).otherwise(F.array("action"))
    return operations.select("section", F.explode(acts).alias("action")).groupBy("section", "action").agg(F.count("*").alias("n"))


def counts_json(counts: DataFrame) -> tuple[str, str, str]:
    """(inserts, updates, all counts) as JSON texts; at most sections x actions rows reach the driver."""
    import json
    table: dict[str, dict[str, int]] = {"insert": {}, "update": {}, "archive": {}, "noop": {}}
    sync, total = 0, 0
    for r in counts.collect():
        if r["action"] == "sync_event":
            sync += r["n"]
        else:
            table[r["action"]][r["section"]] = r["n"]
    total = sync + sum(sum(t.values()) for t in table.values())
    return (json.dumps(table["insert"], sort_keys=True), json.dumps(table["update"], sort_keys=True),
            json.dumps({**table, "sync_event": sync, "total": total}, sort_keys=True))


def dense_index(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Global 0-based position without a one-task window: range-partition, number inside
    each partition, then add the sizes of the partitions before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pid = F.spark_partition_id()
    tagged = cut(ranged.withColumn("_pid", pid).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    sizes = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    return tagged.join(sizes.select("_pid", before.alias("_before")), "_pid").withColumn("op_index", (F.col("_before") + F.col("_pos")).cast("int")).drop("_pid", "_pos", "_before")


def order_operations(operations: DataFrame) -> DataFrame:
    """Operations with op_index by action rank, section rank and input order."""
    def rank(column: str, ranks: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(column)]
    width = F.lpad("row_index", 20, "0")
    order = [rank("action", ACTION_RANK), rank("section", SECTION_RANK), F.when(F.col("row_index").rlike("^[0-9]+$"), width).otherwise(F.col("row_index"))]
    return dense_index(operations, order, "ordered-operations")


# --- apply ---------------------------------------------------------------------------

WHOLE_FIELDS = {"validations": {"status", "expected_value", "measured_value", "details_json"}}


def _fold(section: str, ops: DataFrame) -> DataFrame:
    """Several updates of one row in one manifest become one: later non-null values win."""
    key = "existing_id"
    fields = [c for c in MANIFEST_FIELDS[section] if c != "id"]
    whole = WHOLE_FIELDS.get(section, set()) | {"attrs_json"}
    order = F.col("row_index")
    return ops.groupBy(key).agg(
        F.max_by("old", order).alias("old"),
        *[(F.max_by(F.struct(c), order)[c] if c in whole else F.max_by(c, F.when(F.col(c).isNotNull(), order))).alias(c) for c in fields])


def _updated_rows(l: Ledger, section: str, ops: DataFrame) -> DataFrame:
    folded = _fold(section, ops)
    fields = set(MANIFEST_FIELDS[section]) - {"id"}
    whole = WHOLE_FIELDS.get(section, set())
    out = []
    for name, _kind, _null in schemas.columns(section):
        old = F.col(f"old.{name}")
        if name == "updated_at":
            col = l.now
        elif name == "attrs_json":
            col = F.when(F.col("attrs_json").isNull(), canonical_object(old)).otherwise(canonical_object(F.col("attrs_json")))
        elif section == "job_runs" and name == "deleted_at":
            col = F.lit(None).cast("timestamp_ntz")
        elif section == "metrics" and name != "value":
            col = old
        elif name in whole:
            col = _typed(section, name)
        elif section == "notes" and name == "resolved_at":
            col = old
        elif name in fields and name not in ("job_id", "run_id") or (name in fields and section not in ("job_runs",)):
            col = F.coalesce(_typed(section, name), old)
        else:
            col = old
        out.append(col.alias(name))
    return folded.select(*out)


_DEFAULTS = {"runs": {"status": "active", "kind": "datapoint"}, "jobs": {"status": "planned"}, "job_runs": {"role": "other", "status": "planned"},
             "notes": {"status": "open", "body_format": "markdown"}, "validations": {"details_json": "{}"}, "sync_events": {"origin": "manifest"}}


def _inserted_rows(l: Ledger, section: str, ops: DataFrame, stamp_cols: tuple[str, ...] = ("created_at", "updated_at")) -> DataFrame:
    defaults = _DEFAULTS.get(section, {})
    cols = []
    for name, _kind, _null in schemas.columns(section):
        if name == "id":
            col = F.col("target_id")
        elif name in stamp_cols:
            col = l.now
        elif name == "attrs_json":
            col = F.when(F.col("attrs_json").isNull(), F.lit("{}")).otherwise(canonical_object(F.col("attrs_json")))
        elif name in MANIFEST_FIELDS[section]:
            col = _typed(section, name)
            if name in defaults:
                col = F.coalesce(col, F.lit(defaults[name]))
        else:
            continue
        cols.append(col.alias(name))
    return conform(ops.select(*cols), section)


def _archived_rows(l: Ledger, section: str, ops: DataFrame) -> DataFrame:
    once = ops.dropDuplicates(["existing_id"])
    out = []
    for name, _kind, _null in schemas.columns(section):
        col = F.col(f"old.{name}")
        if name == "deleted_at":
            col = F.coalesce(col, l.now)
        elif name == "updated_at":
            col = l.now
        elif name == "status" and section == "runs":
            col = F.lit("archived")
        out.append(col.alias(name))
    return once.select(*out)


def _section_rows(l: Ledger, section: str, ops: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rows in their new state, added rows) of a section's table."""
    if section == "sync_events":
        return None, _inserted_rows(l, section, ops.filter(F.col("action") == "sync_event"))
    archived = ops.filter(F.col("action").isin("archive", "errata_replace"))
    updates = ops.filter(F.col("action") == "update")
    both = _updated_rows(l, section, updates)
    gone_rows = _archived_rows(l, section, archived)
    # A row updated and archived in one manifest ends archived with its updates.
    key = list(schemas.KEYS[section])
    late = both.join(gone_rows.select(*key), key, "left_semi").withColumn("deleted_at", F.coalesce("deleted_at", l.now))
    if section == "runs":
        late = late.withColumn("status", F.lit("archived"))
    changed = both.join(gone_rows.select(*key), key, "left_anti").unionByName(gone_rows.join(both.select(*key), key, "left_anti")).unionByName(late)
    return changed.select(*l.table(section).columns), _inserted_rows(l, section, ops.filter(F.col("action").isin("insert", "errata_replace")))


def apply_rows(l: Ledger, the_plan: Plan, event_id: Column | None = None) -> Ledger:
    """Ledger after all operations, without the logs.  The rows it changes are stored once, and nothing else is."""
    delta: dict[str, DataFrame] = {}
    fresh: dict[str, DataFrame] = {}
    for section, ops in the_plan.sections.items():
        if section != "custom_attributes":
            changed, added = _section_rows(l, section, ops)
            if changed is not None:
                delta[section] = cut(changed, f"changed-{section}", CODEC)
            if section == "sync_events" and event_id is not None:
                added = added.withColumn("reconcile_event_id", event_id).select(*added.columns)
            fresh[section] = cut(added, f"added-{section}", CODEC)
    if "runs" in the_plan.sections:
        fresh["experiment_runs"] = cut(_new_links(l, the_plan.sections["runs"]), "added-links")
    after = l.with_rows(delta, fresh)
    if "custom_attributes" in the_plan.sections:
        after = after.with_rows(_attribute_rows(l, the_plan.sections["custom_attributes"], after))
    return after


def apply_updates(l: Ledger, the_plan: Plan) -> dict[str, DataFrame]:
    """The tables of ``apply_rows`` that the plan's sections touch."""
    after = apply_rows(l, the_plan)
    return {t: after.tables[t] for t in after.delta}


def _attribute_rows(l: Ledger, ops: DataFrame, after: Ledger) -> dict[str, DataFrame]:
    """Rows with merged attributes; of one key given twice the later row wins."""
    updates = ops.filter(F.col("action") == "update")
    keyed = updates.select("entity_type", "entity_id", "row_index", F.explode(attr_map(F.col("attrs_json"))).alias("k", "val")).groupBy("entity_type", "entity_id", "k").agg(
        F.max_by(F.to_json("val"), "row_index").alias("text"))
    # one entry per attribute name of the entity, so the list is as long as its attribute object
    pairs = F.concat(F.to_json(F.array("k")).substr(F.lit(2), F.length(F.to_json(F.array("k"))) - 2), F.lit(":"), F.coalesce("text", F.lit("null")))
    merged = cut(keyed.groupBy("entity_type", "entity_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pairs), ","), F.lit("}")).alias("new_attrs")), "new-attributes")
    out = {}
    for kind in ("experiment", "run", "job", "artifact"):
        table = schemas.ENTITY_TABLE[kind]
        hit = merged.filter(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"), "new_attrs")
        rows = after.table(table).join(hit, "id").withColumn("updated_at", l.now).withColumn("attrs_json", merge_objects(F.col("attrs_json"), F.col("new_attrs")))
        out[table] = cut(rows.select(*after.table(table).columns), f"attributes-{table}")
    return out


def _new_links(l: Ledger, run_plan: DataFrame) -> DataFrame:
    bridge = l.table("experiment_runs")
    fresh = run_plan.filter(F.col("action").isin("insert", "update") & F.col("experiment_id").isNotNull()).select(
        "experiment_id", F.col("target_id").alias("run_id")).distinct()
    there = bridge.select("experiment_id", "run_id").join(fresh, ["experiment_id", "run_id"], "left_semi")
    return fresh.join(there, ["experiment_id", "run_id"], "left_anti").withColumn("created_at", l.now).select(*bridge.columns)


def link_experiment_runs(l: Ledger, run_plan: DataFrame) -> DataFrame:
    """Bridge table plus missing links of planned runs that name an experiment."""
    return l.table("experiment_runs").unionByName(_new_links(l, run_plan))


def apply_plan(l: Ledger, the_plan: Plan, source: str, experiment_id: str | None = None, session_id: str | None = None) -> Ledger:
    """Ledger after the plan, with its reconcile event and operation rows.  Raises on any error row."""
    bad = the_plan.errors.limit(5).collect()
    if bad:
        raise ReconcileError("; ".join(f"{r['section']}[{r['row_index']}]: {r['error']}" for r in bad))
    ordered = order_operations(the_plan.operations)
    inserts, updates, counts = counts_json(the_plan.counts())
    event_id = F.concat(F.lit("rec_"), F.substring(F.sha2(F.lit(f"{source}|{l.as_of}|{apply_number(l)}|{counts}"), 256), 1, 26))
    event = l.spark.range(1).select(event_id.alias("id"), F.lit(experiment_id).cast("string").alias("experiment_id"), F.lit(source).alias("source"), F.lit(inserts).alias("inserts_json"),
                                    F.lit(updates).alias("updates_json"), l.now.alias("created_at"), F.lit(counts).alias("counts_json"), F.lit(session_id).cast("string").alias("session_id"))
    ops = ordered.select(F.concat(F.lit("recop_"), F.substring(F.sha2(F.concat_ws("|", event_id, F.col("op_index").cast("string")), 256), 1, 26)).alias("id"), event_id.alias("reconcile_event_id"),
                         "op_index", F.col("section").alias("entity"), "action", "entity_id", "input_json", "diff_json")
    after = apply_rows(l, the_plan, event_id)
    return after.with_rows({}, {"reconcile_events": conform(event, "reconcile_events"), "reconcile_operations": cut(conform(ops, "reconcile_operations"), "operations")})


def reconcile(l: Ledger, manifest: dict[str, DataFrame], source: str, apply: bool = False, experiment_id: str | None = None, session_id: str | None = None) -> tuple[Plan, Ledger]:
    """Dry run (plan only) or plan and apply."""
    the_plan = plan(l, manifest, experiment_id, session_id)
    return the_plan, apply_plan(l, the_plan, source, experiment_id, session_id) if apply else l


def upsert_keep_existing(l: Ledger, table: str, rows: DataFrame) -> DataFrame:
    """Create rows whose idempotency key is new; an existing active row with the key stays untouched."""
    keys = ["experiment_id", "idempotency_key"] if table == "runs" else ["idempotency_key"]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    taken = l.active(table).select(*keys)
    first = rows.filter(whole).groupBy(*keys).agg(F.min("id").alias("id"))
    keyed = rows.join(first, [*keys, "id"], "left_semi").join(taken, keys, "left_anti")
    return l.table(table).unionByName(conform(rows.filter(~whole).unionByName(keyed), table))
