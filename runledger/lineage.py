"""Cutting lineage of iterative plans through reliable shared storage.

Iterative algorithms (pointer doubling) re-use their previous state twice per
round, so an uncut plan doubles in size each round.  ``cut`` writes the state as
Parquet under the folder the session names in ``spark.checkpoint.dir`` and reads
it back: the data survives executor loss, and the planner sees true sizes, so
small states are broadcast and large ones are not.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Codec of stored tables and of wide intermediate rows, smaller than Parquet's default.
CODEC = "zstd"

#: A write of so many seconds may leave large shuffle files behind.
LONG_WRITE_S = 10.0

_scratch: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for cut lineage; only a local-mode session without the setting gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="runledger-")
        atexit.register(shutil.rmtree, _scratch[app], True)
    return _scratch[app]


def cut(df: DataFrame, label: str, codec: str | None = None, **options: object) -> DataFrame:
    """Materialise ``df`` on shared storage and return a fresh scan of it; ``options`` are those of Parquet's writer."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/runledger/{label}-{uuid.uuid4().hex}"
    out = df.write.options(**options)
    out = out.option("compression", codec) if codec else out
    put(spark, out, path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, out: DataFrameWriter, path: str) -> None:
    """Write a new Parquet folder."""
    began = time.monotonic()
    out.mode("errorifexists").parquet(path)
    if time.monotonic() - began > LONG_WRITE_S:
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more.

    Its cleaner learns of them from the driver's garbage collector only, which may not run for a whole job.  The
    first of two rounds drops what the second finds unused.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
