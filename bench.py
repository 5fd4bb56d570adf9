"""Headline queries over a stored ledger; prints one JSON line.

The star-schema tables are first turned into a Parquet ledger (timed as ``setup``),
which is what a deployment would hold; queries then read that ledger.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

from runledger.operators import audit, exports, freshness, lifecycle, reconcile, reports, views
from runledger.projection import AS_OF, project
from runledger.session import local_session
from runledger.sources.store import load_ledger, save_changes, save_ledger


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def manifest(l):
    """About a tenth of the jobs: thirds unchanged, changed and new."""
    h = F.abs(F.xxhash64("id"))
    some = l.table("jobs").filter(h % 10 == 0).withColumn("row_index", F.monotonically_increasing_id())
    return {"jobs": some.select("row_index", F.when(h % 3 == 2, F.concat(F.lit("new_"), "id")).otherwise(F.col("id")).alias("id"),
                                F.when(h % 3 == 1, "killed").otherwise(F.col("status")).alias("status"))}


def reconcile_apply(l, root: str) -> None:
    """Plan with all checks, apply with its logs, and save the changed buckets into the stored ledger."""
    the_plan = reconcile.plan(l, manifest(l))
    save_changes(reconcile.apply_plan(l, the_plan, "bench"), root)


CASES = {
    "v_runs_progress": lambda l: sink(views.runs_progress(l)),
    "v_jobs_with_recovery": lambda l: sink(views.jobs_with_recovery(l)),
    "v_dashboard_experiments": lambda l: sink(lifecycle.lifecycle(l)),
    "v_experiment_summary": lambda l: sink(views.experiment_summary(l)),
    "v_artifacts_redacted": lambda l: sink(views.artifacts_redacted(l)),
    "v_metric_coverage": lambda l: sink(views.metric_coverage(l)),
    "experiment_freshness": lambda l: sink(freshness.experiment_freshness(l)),
    "experiment_status": lambda l: sink(reports.experiment_status(l)),
    "export_runs_wide": lambda l: sink(exports.export_runs_wide(l, check=False)),
    "full_audit": lambda l: sink(audit.run_audit(l)),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores=cores, app="runledger-bench", memory="16g")
    root = tempfile.mkdtemp(prefix="run-bench-")
    t = time.time()
    source = project(spark, sf_dir)
    save_ledger(source, f"{root}/ledger", index=True)
    setup = round(time.time() - t, 3)
    source.inventory.write.parquet(f"{root}/inventory")
    inventory = spark.read.parquet(f"{root}/inventory")

    # a fresh ledger per run, so nothing memoised survives between timings
    def fresh(folder=f"{root}/ledger"):
        return load_ledger(spark, folder, AS_OF, inventory=inventory)

    def apply_again():
        """Every run applies to a copy of the stored ledger, since it changes it."""
        copy = f"{root}/{time.time_ns()}"
        shutil.copytree(f"{root}/ledger", copy)
        return lambda: reconcile_apply(fresh(copy), copy)

    cases = {name: (lambda run=run: lambda: run(fresh())) for name, run in CASES.items()} | {"reconcile_plan_apply": apply_again}
    queries, failed = {}, {}
    for name, prepare in cases.items():
        try:
            prepare()()
            times = []
            for _ in range(repeats):
                run = prepare()
                t = time.time()
                run()
                times.append(time.time() - t)
            queries[name] = round(statistics.median(times), 3)
            print(name, queries[name], file=sys.stderr, flush=True)
        except Exception as error:  # noqa: BLE001 - the other figures still count
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
            print(name, failed[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "failed": failed,
                      "sf": sf_dir.rstrip("/").split("sf")[-1], "setup_sec": setup, "cores": cores, "spark": spark.version}))


if __name__ == "__main__":
    main()
