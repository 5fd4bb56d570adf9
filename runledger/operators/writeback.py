"""Planning and recording of metric writes to an outside tracker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions import text as tx
from runledger.ledger import Ledger, conform
from runledger.lineage import cut
from runledger.operators.ownership import flag

TRACKER = "wandb"
DEFAULT_KEY_PREFIX = "ledger"


def resolve_targets(l: Ledger) -> DataFrame:
    """(run_id, target_identifier): the run's own tracker id, else its parent's; one level only."""
    def own(prefix: str):
        return F.when((F.col("external_system") == TRACKER) & (F.col("external_id") != ""), F.col("external_id")).alias(prefix)

    runs = l.table("runs")
    parents = runs.select(F.col("id").alias("parent_run_id"), own("parent_target"))
    return runs.select(F.col("id").alias("run_id"), "parent_run_id", own("own_target"), F.col("deleted_at").isNotNull().cast("int").alias("is_archived")).join(
        parents, "parent_run_id", "left").select("run_id", F.coalesce("own_target", "parent_target").alias("target_identifier"), "is_archived")


def select_metrics(l: Ledger, patterns: list[str]) -> DataFrame:
    if not patterns:
        raise ValueError("at least one metric pattern is needed")
    return l.active("metrics").filter(tx.matches_any(F.col("metric_name"), patterns))


def target_prefix(key_prefix: str | None, raw_keys: bool) -> str | None:
    if raw_keys:
        if key_prefix is not None:
            raise ValueError("raw keys take no prefix")
        return None
    prefix = DEFAULT_KEY_PREFIX if key_prefix is None else key_prefix.strip()
    if not prefix:
        raise ValueError("empty key prefix; ask for raw keys instead")
    return prefix.rstrip("/")


def plan_writeback(l: Ledger, patterns: list[str], key_prefix: str | None = None, raw_keys: bool = False, allow_rewrite: bool = False,
                   target: str | None = None, force_target: bool = False) -> DataFrame:
    """One row per matching metric of every run, with ``action``:

    planned, already_synced, or an error: archived_run, no_target, target_mismatch, field_collision.
    """
    prefix = target_prefix(key_prefix, raw_keys)
    resolved = resolve_targets(l)
    if target is not None:
        differs = F.col("target_identifier").isNotNull() & (F.col("target_identifier") != target) & F.lit(not force_target)
        resolved = resolved.withColumn("mismatch", differs).withColumn("target_identifier", F.lit(target))
    else:
        resolved = resolved.withColumn("mismatch", F.lit(False))
    name = F.col("metric_name")
    rows = select_metrics(l, patterns).join(resolved, "run_id").withColumn("target_field", name if prefix is None else F.concat(F.lit(prefix + "/"), name)).withColumn(
        "idempotency_key", F.concat_ws(":", F.lit(f"{TRACKER}-summary"), "id", "target_identifier", "target_field"))
    clash = rows.groupBy("run_id", "target_field").agg(F.count("*").alias("n")).filter("n > 1").select("run_id", "target_field", F.lit(1).alias("clash"))
    events = l.table("sync_events").filter((F.col("target_system") == TRACKER) & (F.col("origin") == "writeback"))
    latest = events.filter(F.col("idempotency_key").isNotNull()).groupBy("target_identifier", "idempotency_key").agg(
        F.max(F.struct("created_at", "id", "status")).alias("last")).select(
        "target_identifier", "idempotency_key", F.col("last.id").alias("latest_sync_event_id"), F.col("last.status").alias("latest_status"))
    known = events.select("target_identifier").distinct().withColumn("written", F.lit(1))
    out = rows.join(clash, ["run_id", "target_field"], "left").join(latest, ["target_identifier", "idempotency_key"], "left").join(known, "target_identifier", "left")
    action = (F.when(F.col("is_archived") == 1, "archived_run").when(F.col("target_identifier").isNull(), "no_target")
              .when(F.col("mismatch"), "target_mismatch").when(F.col("clash").isNotNull(), "field_collision")
              .when((F.col("latest_status") == "synced") & F.lit(not allow_rewrite), "already_synced").otherwise("planned"))
    return out.select(
        F.col("run_id").alias("source_run_id"), F.col("id").alias("source_metric_id"), "metric_name", "step", "split", "value", "target_identifier",
        "target_field", "idempotency_key", "latest_sync_event_id", action.alias("action"), flag(F.col("written").isNull() & F.col("target_identifier").isNotNull()).alias("first_write"))


def writeback_errors(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("action").isin("archived_run", "no_target", "target_mismatch", "field_collision"))


def _result_id():
    return F.concat(F.lit("sync_"), F.substring(F.sha2(F.concat_ws("|", "idempotency_key", F.col("created_at").cast("string")), 256), 1, 24))


def record_results(l: Ledger, results: DataFrame) -> DataFrame:
    """Append push results (plan columns + ``ok`` + ``error_message``) to the sync events table."""
    rows = results.withColumn("created_at", l.now)
    fresh = rows.select(
        _result_id().alias("id"), F.lit(TRACKER).alias("target_system"), "target_identifier", F.when(F.col("ok"), "synced").otherwise("failed").alias("status"),
        F.col("source_run_id").alias("run_id"), tx.sanitize_error(F.col("error_message")).alias("error_message"), "created_at", "idempotency_key",
        F.lit("writeback").alias("origin"), F.lit("metric").alias("source_entity_type"), F.col("source_metric_id").alias("source_entity_id"), "target_field",
        F.concat(F.lit('{"value": '), F.col("value").cast("string"), F.lit("}")).alias("payload_summary_json"))
    return l.table("sync_events").unionByName(conform(fresh, "sync_events"))


Writer = Callable[[str, str, float], tuple[bool, str | None]]


def push(plan: DataFrame, make_writer: Callable[[], Writer], first_write_ok: bool = False) -> DataFrame:
    """Run a user-supplied writer over the planned rows, one writer per task.

    Results are written to shared storage straight away: pushing twice because a
    later stage re-reads the plan would write twice to the tracker.  A lost task
    may repeat its own writes, which set the same field to the same value.
    """
    planned = plan.filter(F.col("action") == "planned")
    if not first_write_ok and not planned.filter(F.col("first_write") == 1).isEmpty():
        raise ValueError("first write to a target needs first_write_ok")
    schema = T.StructType([*planned.schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("error_message", T.StringType())])

    def run(batches: Iterator):
        writer = make_writer()
        for pdf in batches:
            done = [writer(t, f, float(v)) for t, f, v in zip(pdf["target_identifier"], pdf["target_field"], pdf["value"])]
            pdf["ok"] = [d[0] for d in done]
            pdf["error_message"] = [d[1] for d in done]
            yield pdf

    return cut(planned.mapInPandas(run, schema), "push-results")
