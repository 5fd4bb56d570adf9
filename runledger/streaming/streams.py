"""Continuous forms of the batch flows, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from runledger import schemas
from runledger.operators import reconcile as rc
from runledger.sources import ingest
from runledger.sources.store import load_ledger, save_changes

LINE_SCHEMA = StructType([StructField("row_index", LongType()), StructField("text", StringType())])
ADAPTERS: dict[str, Callable[[DataFrame], ingest.Ingest]] = {
    "scheduler-jobs-json": ingest.ingest_scheduler_jobs, "tracker-runs-json": ingest.ingest_tracker_runs, "artifacts-json": ingest.ingest_artifacts_json}


def stream_manifests(spark: SparkSession, folder: str, adapter: str, root: str, checkpoint: str, as_of: datetime,
                     experiment_id: str | None = None, available_now: bool = True) -> StreamingQuery:
    """New files of JSON rows in ``folder`` -> adapter -> reconcile -> next ledger version.

    Rows match ledger rows by natural key, so a batch replayed after a lost driver
    plans to no-ops and adds no version.
    """
    rows = spark.readStream.schema(LINE_SCHEMA).json(folder).select("row_index", "text", F.col("_metadata.file_path").alias("file"))

    def apply_batch(batch: DataFrame, _batch_id: int) -> None:
        ledger = load_ledger(spark, root, as_of)
        fed = ADAPTERS[adapter](ingest.rows_from_json_text(ingest.number_by_file(batch), "text", "row_index"))
        the_plan = rc.plan(ledger, fed.sections, experiment_id)
        if the_plan.operations.filter(F.col("action") != "noop").isEmpty():
            return
        save_changes(rc.apply_plan(ledger, the_plan, f"stream:{adapter}", experiment_id), root)

    writer = rows.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedupe_sync_events(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Manifest sync events with each idempotency key kept once within the watermark; events without key pass."""
    timed = stream.withColumn("event_time", F.col("created_at").cast("timestamp")).withWatermark("event_time", delay)
    # keyless events get their own id as key, so one stateful operator serves both kinds
    key = F.coalesce("idempotency_key", F.concat(F.lit("\u0000"), "id"))
    return timed.withColumn("_ident", F.coalesce("target_identifier", F.lit(""))).withColumn("_key", key).dropDuplicatesWithinWatermark(
        ["target_system", "_ident", "_key"]).drop("_ident", "_key", "event_time")


def stream_sync_dedupe(spark: SparkSession, folder: str, output: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Parquet folder of sync events -> deduplicated Parquet folder."""
    events = spark.readStream.schema(schemas.struct("sync_events")).parquet(folder)
    return (dedupe_sync_events(events, delay).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
