"""Adapters: raw snapshots (JSON, CSV) -> manifest sections plus skipped rows.

No schema inference anywhere.  JSON lists are read as one ``array<variant>`` or
``{"<key>": [...]}`` document per file and exploded with their position, so a bad
row never loses its neighbours and keeps its index and source text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions import validate as v
from runledger.functions.attrs import canonical_object
from runledger.ledger import Ledger
from runledger.lineage import CODEC, cut
from runledger.operators import integrity
from runledger.operators.ownership import union_all
from runledger.schemas import ARTIFACT_TYPES, JOB_STATUSES, RUN_STATUSES
from runledger.sources import splitting

SECTIONS = ["runs", "jobs", "artifacts", "metrics", "notes", "validations", "custom_attributes", "sync_events"]
SCHEDULER = "iris"
TRACKER = "wandb"
TRACKER_FIELDS = ["url", "project", "entity", "state", "summary"]


class IngestFailure(ValueError):
    """The input as a whole is unusable, or strict mode met a skipped row."""


@dataclass
class Ingest:
    adapter: str
    rows: DataFrame
    sections: dict[str, DataFrame]
    skipped: DataFrame
    extra: dict = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """One row: outcome, input_rows, skipped_rows and emitted count per section."""
        bad = F.col("error").isNotNull()
        base = self.rows.agg(F.count("*").alias("input_rows"), F.coalesce(F.sum(bad.cast("bigint")), F.lit(0).cast("bigint")).alias("skipped_rows"))
        good = F.col("input_rows") - F.col("skipped_rows")
        return base.select(
            F.lit(self.adapter).alias("adapter"), F.when(F.col("skipped_rows") > 0, "partial").otherwise("clean").alias("outcome"), "input_rows", "skipped_rows",
            *[(good if s in self.sections else F.lit(0).cast("bigint")).alias(f"emitted_{s}") for s in SECTIONS])

    def strict(self) -> "Ingest":
        if not self.skipped.isEmpty():
            raise IngestFailure("some rows were skipped in strict mode")
        return self


#: Rows of a file are numbered from its place among the files times this.
FILE_SPAN = 1 << 40


def number_by_file(rows: DataFrame, file: str = "file") -> DataFrame:
    """Make ``row_index`` unique over several files: positions restart in each.  The rows of the first file keep their numbers."""
    places = rows.select(file).distinct().withColumn("_place", F.row_number().over(Window.orderBy(file)) - 1)  # one row per file
    return rows.join(places, file).withColumn("row_index", F.col("row_index") + F.col("_place") * F.lit(FILE_SPAN)).drop("_place", file)


def read_json_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(row_index, row variant) of ``[...]`` or ``{"<key>": [...]}`` documents, one document per file; many tasks read a large one."""
    wrong = IngestFailure(f"input must be a JSON list or an object with a {key!r} list")
    try:
        elements, members = splitting.read_json_elements(spark, path)
    except ValueError as error:
        raise wrong from error
    listed = members.filter((F.col("kind") == "list") & (F.col("key").isNull() | (F.col("key") == key))).select("file")
    if not members.select("file").distinct().join(listed, "file", "left_anti").isEmpty() or members.isEmpty():
        raise wrong
    own = elements.filter(F.col("key").isNull() | (F.col("key") == key))
    return number_by_file(own.select(F.col("nth").alias("row_index"), F.try_parse_json("text").alias("row"), "file")).select("row_index", "row")


def rows_from_json_text(df: DataFrame, column: str, index: str) -> DataFrame:
    """(row_index, row variant) from one JSON object text per row, for line-delimited feeds."""
    return df.select(F.col(index).alias("row_index"), F.try_parse_json(column).alias("row"))


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("row", path, "variant"))


def _text(name: str) -> Column:
    """Field as text; absent, null and "" are all missing."""
    return F.nullif(F.try_variant_get("row", f"$.{name}", "string"), F.lit(""))


def _attrs() -> Column:
    return F.when(_kind("$.attrs").startswith("OBJECT"), F.to_json(F.try_variant_get("row", "$.attrs", "variant")))


def _shape() -> Column:
    """Faults of the source row itself and of the form of its attributes."""
    present = _kind("$.attrs").isNotNull() & (_kind("$.attrs") != "VOID") & ~F.coalesce(F.try_variant_get("row", "$.attrs", "string") == "", F.lit(False))
    return F.array(_object_error(), F.when(present & ~_kind("$.attrs").startswith("OBJECT"), "attrs must be an object")).alias("_shape")


def _judged(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """Rows with ``error``; the source text is written out for rows that have one, nothing reads it of the others."""
    error = _first_error([F.col("_shape")[0], *checks, F.col("_shape")[1], v.attr_keys("attrs_json")])
    return rows.withColumn("error", error).withColumn("source_row", F.when(F.col("error").isNotNull(), F.to_json("row"))).drop("_shape", "row")


def _object_error() -> Column:
    return F.when(~F.coalesce(F.schema_of_variant("row").startswith("OBJECT"), F.lit(False)), "source row must be an object")


def _first_error(checks: list[Column]) -> Column:
    return F.coalesce(*checks)


def _split(adapter: str, rows: DataFrame, emit) -> Ingest:
    """Good rows to sections, bad ones to skipped.  The parsed rows are stored once: sections, skipped
    rows and summary all read them, and a pushed-down error filter would repeat the parsing."""
    rows = cut(rows, f"ingest-{adapter}", CODEC)
    good = rows.filter(F.col("error").isNull())
    skipped = rows.filter(F.col("error").isNotNull()).select(
        "row_index", F.lit("error").alias("severity"), F.col("error").alias("message"), F.col("source_row"))
    return Ingest(adapter, rows, emit(good), skipped)


def _sync(good: DataFrame, adapter: str, system: str, job_id: Column, run_id: Column) -> DataFrame:
    return good.select("row_index", F.lit(system).alias("target_system"), F.col("external_id").alias("target_identifier"), F.lit("synced").alias("status"),
                       F.concat_ws(":", F.lit("adapter"), F.lit(adapter), F.lit(system), "external_id").alias("idempotency_key"),
                       job_id.alias("job_id"), run_id.alias("run_id"), F.lit(f'{{"adapter.name":"{adapter}"}}').alias("attrs_json"))


def ingest_scheduler_jobs(raw: DataFrame) -> Ingest:
    """Scheduler job list -> jobs + sync_events."""
    adapter = "scheduler-jobs-json"
    rows = raw.select(
        "row_index", "row", *[_text(c).alias(c) for c in (
            "id", "run_id", "experiment_id", "name", "command", "launcher", "failure_reason", "external_id", "status", "started_at", "finished_at")],
        _attrs().alias("attrs_json"), _shape())
    rows = _judged(rows, [v.required("external_id"), v.required("status"), v.choice("status", JOB_STATUSES, "job status"),
                          v.utc_z("started_at"), v.utc_z("finished_at")])

    def emit(good: DataFrame) -> dict[str, DataFrame]:
        jobs = good.select("row_index", "id", "run_id", "experiment_id", "name", "command", "launcher", "failure_reason", F.lit(SCHEDULER).alias("external_system"),
                           "external_id", "status", v.parse_utc_z("started_at").alias("started_at"), v.parse_utc_z("finished_at").alias("finished_at"),
                           F.when(F.col("attrs_json") != "{}", canonical_object(F.col("attrs_json"))).alias("attrs_json"))
        return {"jobs": jobs, "sync_events": _sync(good, adapter, SCHEDULER, F.col("id"), F.lit(None).cast("string"))}

    return _split(adapter, rows, emit)


def ingest_tracker_runs(raw: DataFrame) -> Ingest:
    """Tracker run list -> runs + sync_events; tracker fields become attributes, explicit attrs win."""
    adapter = "tracker-runs-json"
    base = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*[
        F.when(_kind(f"$.{f}").isNotNull() & (_kind(f"$.{f}") != "VOID") & F.coalesce(_text(f).isNotNull() | ~_kind(f"$.{f}").startswith("STRING"), F.lit(True)),
               F.concat(F.lit(f'"{TRACKER}.{f}":'), F.to_json(F.try_variant_get("row", f"$.{f}", "variant")))) for f in TRACKER_FIELDS]),
        lambda x: x.isNotNull()), ","), F.lit("}"))
    rows = raw.select(
        "row_index", "row", *[_text(c).alias(c) for c in ("description", "parent_run_id", "experiment_id", "name")],
        F.coalesce(_text("external_id"), _text("id")).alias("external_id"),
        F.when(_kind("$.status").isNull(), "active").otherwise(F.try_variant_get("row", "$.status", "string")).alias("status"),
        base.alias("base_json"), _attrs().alias("attrs_json"), _shape())
    rows = _judged(rows, [v.required("external_id", label="id"), v.required("name"), F.coalesce(
        F.when(F.col("status").isNull(), "invalid run status"), v.choice("status", RUN_STATUSES, "run status"))])

    def emit(good: DataFrame) -> dict[str, DataFrame]:
        from runledger.functions.attrs import merge_objects
        merged = merge_objects(F.col("base_json"), F.coalesce("attrs_json", F.lit("{}")))
        runs = good.select("row_index", "description", "parent_run_id", "experiment_id", F.lit(TRACKER).alias("external_system"), "external_id", "name", "status",
                           F.nullif(merged, F.lit("{}")).alias("attrs_json"))
        none = F.lit(None).cast("string")
        return {"runs": runs, "sync_events": _sync(good, adapter, TRACKER, none, none)}

    return _split(adapter, rows, emit)


METRIC_FIELDS = ["run_id", "metric_name", "value", "step", "split", "source_job_id", "source_artifact_id"]


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with ``row_index`` in file order; many tasks read a large file, line ends inside quotes included."""
    df, names = splitting.read_csv(spark, path)
    if not {"metric_name", "value"} <= set(names):
        raise IngestFailure("metric CSV needs the columns metric_name and value")
    return number_by_file(df)


def ingest_metrics_csv(raw: DataFrame) -> Ingest:
    """Text rows -> metrics; values must be finite numbers, steps stay text."""
    source = F.to_json(F.struct(*[c for c in raw.columns if c != "row_index"]))
    rows = raw.select("row_index", source.alias("source_row"), *[
        (F.nullif(F.col(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in METRIC_FIELDS])
    number = v.python_float(F.col("value"))
    rows = rows.withColumn("number", number).withColumn("error", _first_error([
        F.when(F.col("run_id").isNull() | F.col("metric_name").isNull() | F.col("value").isNull(),
               "metric rows need run_id, metric_name and value"),
        F.when(F.col("number").isNull(), F.concat(F.lit("could not convert string to float: "), F.col("value"))),
        F.when(F.isnan("number") | (F.abs("number") == float("inf")), "metric value must be finite")]))

    def emit(good: DataFrame) -> dict[str, DataFrame]:
        return {"metrics": good.select("row_index", "run_id", "metric_name", F.col("number").alias("value"), "step", "split", "source_job_id", "source_artifact_id")}

    return _split("metrics-csv", rows, emit)


def ingest_artifacts_json(raw: DataFrame) -> Ingest:
    rows = raw.select("row_index", "row", *[_text(c).alias(c) for c in ("id", "experiment_id", "run_id", "job_id", "type", "uri")],
                      F.try_variant_get("row", "$.content_hash", "string").alias("content_hash"), _attrs().alias("attrs_json"), _shape())
    rows = _judged(rows, [v.required("type"), v.choice("type", ARTIFACT_TYPES, "artifact type"), v.required("uri"),
                          F.when(F.coalesce("experiment_id", "run_id", "job_id").isNull(), "artifact rows need experiment_id, run_id or job_id"),
                          v.content_hash("content_hash")])

    def emit(good: DataFrame) -> dict[str, DataFrame]:
        return {"artifacts": good.select("row_index", "id", "experiment_id", "run_id", "job_id", "type", "uri", F.lower("content_hash").alias("content_hash"),
                                         F.when(F.col("attrs_json") != "{}", canonical_object(F.col("attrs_json"))).alias("attrs_json"))}

    return _split("artifacts-json", rows, emit)


# --- bulk metrics, submissions, refresh events -------------------------------------------

def resolve_bulk_metrics(l: Ledger, raw: DataFrame) -> DataFrame:
    """CSV rows with aliases -> metric manifest rows, each with ``error`` when a reference fails.

    run_id/run and metric_name/name are aliases; a run or job may be given by id or unique active name.
    """
    from runledger.operators.reports import resolve_refs

    def pick(*names: str) -> Column:
        have = [F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    rows = raw.select("row_index", pick("run_id", "run").alias("run_ref"), pick("metric_name", "name").alias("metric_name"),
                      (F.col("value") if "value" in raw.columns else F.lit(None).cast("string")).alias("raw_value"),
                      *[pick(c).alias(c) for c in ("step", "split", "source_job_id", "source_artifact_id")])
    runs = resolve_refs(l, "runs", rows.select(F.col("run_ref").alias("ref")).filter("ref IS NOT NULL")).select(
        F.col("ref").alias("run_ref"), F.col("id").alias("run_id"), F.col("status").alias("run_state"))
    jobs = resolve_refs(l, "jobs", rows.select(F.col("source_job_id").alias("ref")).filter("ref IS NOT NULL")).select(
        F.col("ref").alias("source_job_id"), F.col("id").alias("job_id"), F.col("status").alias("job_state"))
    arts = l.table("artifacts").select(F.col("id").alias("source_artifact_id"), F.lit(1).alias("art_known"))
    out = rows.join(runs, "run_ref", "left").join(jobs, "source_job_id", "left").join(arts, "source_artifact_id", "left")
    value = v.python_float(F.col("raw_value"))
    error = _first_error([
        F.when(F.col("run_ref").isNull() | F.col("metric_name").isNull() | F.col("raw_value").isNull(), "metric CSV needs run_id/run, metric_name/name and value"),
        F.when(F.col("run_state") != "ok", F.concat(F.lit("run reference is "), "run_state")),
        F.when(value.isNull(), "metric value must be numeric"),
        F.when(F.col("job_state") != "ok", F.concat(F.lit("job reference is "), "job_state")),
        F.when(F.col("source_artifact_id").isNotNull() & F.col("art_known").isNull(), "artifact reference is missing")])
    return out.select("row_index", "run_id", "metric_name", value.alias("value"), "step", "split", F.col("job_id").alias("source_job_id"), "source_artifact_id", error.alias("error"))


def bulk_import_metrics(l: Ledger, raw: DataFrame) -> Ledger:
    """Ledger with the metrics of a CSV put in: all rows, or none and a ``ReconcileError``.

    Rows that mean the same metric come one after another, so the last one's value stays.  With
    ``store.update_ledger`` the import lands as a whole on whatever version is the latest by then.
    """
    from runledger.operators import reconcile as rc

    def stop(bad: DataFrame) -> None:
        found = bad.limit(5).collect()
        if found:
            raise rc.ReconcileError("; ".join(f"row {r['row_index']}: {r['error']}" for r in found))

    rows = cut(resolve_bulk_metrics(l, raw), "bulk-rows")
    stop(rows.filter(F.col("error").isNotNull()).select("row_index", "error"))
    keys = ["run_id", "metric_name", "step", "split", "source_job_id", "source_artifact_id"]
    last = rows.groupBy(*keys).agg(F.max("row_index").alias("row_index"), F.max_by("value", "row_index").alias("value"))
    sections = {"metrics": cut(rc.plan_metrics(l, last), "bulk-plan")}
    the_plan = rc.Plan(sections, None, union_all([integrity.reference_errors(l, sections), integrity.unique_errors(l, sections)]))
    stop(the_plan.errors.select("row_index", "error"))
    return rc.apply_rows(l, the_plan)


def submission_resolutions(l: Ledger, manifest_jobs: DataFrame, experiment_id: str | None = None) -> DataFrame:
    """What a manifest settles about uncertain submissions; matched by id only, last row of an id wins."""
    jobs = l.active("jobs").filter(F.col("status").isin("submitting", "unknown_submit"))
    if experiment_id:
        jobs = jobs.filter(F.col("experiment_id") == experiment_id)
    said = manifest_jobs.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max_by(F.struct("status", "external_system", "external_id"), "row_index").alias("m"))
    resolved = F.coalesce("m.status", "status")
    action = F.when(resolved != F.col("status"), "none").when(F.col("status") == "submitting", "wait").otherwise("mark_failed")
    return jobs.join(said, "id", "left").select(
        F.col("id").alias("job_id"), F.col("status").alias("previous_status"), resolved.alias("resolved_status"),
        F.coalesce("m.external_system", "external_system").alias("external_system"), F.coalesce("m.external_id", "external_id").alias("external_id"),
        action.alias("suggested_action"))


def next_action(status: Column, stage: Column) -> Column:
    return (F.when((status == "failed") & (stage == "helper"), "Look at the snapshot and debug files, then run the helper again.")
            .when((status == "failed") & (stage == "adapter"), "Look at the snapshot and the adapter's skipped rows.")
            .when((status == "failed") & (stage == "reconcile"), "Look at the manifest and the reconcile error, then refresh again.")
            .when(status == "failed", "Look at the refresh debug output.")
            .when(status == "dry_run", "Check the manifest, then apply it.").otherwise("Check the experiment status."))


def refresh_next_actions(l: Ledger) -> DataFrame:
    return l.table("refresh_events").select(F.col("id").alias("refresh_event_id"), "status", "stage", next_action(F.col("status"), F.col("stage")).alias("suggested_next_action"))


def record_refresh(l: Ledger, source: str, status: str, stage: str, counts_json: str = "{}", experiment_id: str | None = None,
                   manifest_path: str | None = None, snapshot_path: str | None = None, reconcile_event_id: str | None = None, error_message: str | None = None) -> DataFrame:
    """Refresh events table with one more row (applied, dry_run or failed)."""
    from runledger.ledger import conform
    key = "|".join([source, status, stage, str(l.as_of), str(l.table("refresh_events").count())])
    row = l.spark.range(1).select(
        F.concat(F.lit("refresh_"), F.substring(F.sha2(F.lit(key), 256), 1, 24)).alias("id"), F.lit(source).alias("source"), F.lit(experiment_id).cast("string").alias("experiment_id"),
        F.lit(status).alias("status"), F.lit(stage).alias("stage"), l.now.alias("started_at"), l.now.alias("finished_at"), F.lit(snapshot_path).cast("string").alias("snapshot_path"),
        F.lit(manifest_path).cast("string").alias("manifest_path"), F.lit(reconcile_event_id).cast("string").alias("reconcile_event_id"), F.lit(counts_json).alias("counts_json"),
        F.lit("[]").alias("command_argv_json"), F.lit(error_message).cast("string").alias("error_message"))
    return l.table("refresh_events").unionByName(conform(row, "refresh_events"))


def union_sections(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Merge the sections of several ingests into one manifest; row numbers of the later ones are set apart."""
    def apart(df: DataFrame, k: int) -> DataFrame:
        if not k:
            return df
        row = F.col("row_index")
        return df.withColumn("row_index", F.concat(F.lit(f"{k}:"), row) if dict(df.dtypes)["row_index"] == "string" else row + F.lit(k << 56))

    merged: dict[str, DataFrame] = {}
    for name in {n for p in parts for n in p}:
        merged[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [apart(p[name], k) for k, p in enumerate(parts) if name in p])
    return merged
