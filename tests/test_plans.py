"""Shape of plans, agreement with DuckDB on a sample of queries, and hot keys."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from runledger.functions import text as tx
from runledger.operators import freshness, lifecycle, views
from runledger.operators.ownership import left_by_key
from runledger.plans.catalog import oracle_queries, spark_queries
from runledger.projection import AS_OF, project
from runledger.sources.store import load_ledger, save_ledger
from tests.conftest import NOW, as_dicts
from tools.compare import rows_of

TABLES = "/root/testdata/sf0.001"
SAMPLE = ["v_runs_progress", "v_experiment_summary", "v_dashboard_experiments", "v_artifacts_redacted", "audit_dangling_note_entity", "experiment_status", "export_coverage_named", "ingest_scheduler_jobs",
          "plan_runs", "apply_updates_metrics", "plan_writeback"]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops_and_filters_reach_the_scan(spark, make_ledger, tmp_path):
    root = str(tmp_path / "led")
    save_ledger(make_ledger(experiments=[{"id": "e1"}], runs=[{"id": "r1"}], jobs=[{"id": "j1", "status": "failed"}]), root)
    l = load_ledger(spark, root, AS_OF)
    for query in (lifecycle.lifecycle, views.experiment_summary, views.runs_progress, views.tracker_sync_coverage, freshness.experiment_freshness):
        text = plan_text(query(l))
        assert "NestedLoop" not in text and "Cartesian" not in text, query.__name__
    text = plan_text(views.jobs_needing_attention(l))
    assert "IsNull(deleted_at)" in text and "command" not in text.split("ReadSchema")[1]


def test_a_third_of_all_rows_on_one_key(make_ledger):
    """One run and one parent job hold a third of the jobs; counts stay whole."""
    jobs = [{"id": f"j{i:03d}", "run_id": "hot" if i % 3 == 0 else f"r{i}", "experiment_id": "e1" if i % 2 else None, "status": "succeeded" if i == 299 else "failed",
             "retry_of": "j000" if i % 3 == 2 else None} for i in range(300)]
    l = make_ledger(experiments=[{"id": f"e{k}"} for k in (1, 2, 3)], runs=[{"id": "hot"}], jobs=jobs, experiment_runs=[{"experiment_id": f"e{k}", "run_id": "hot"} for k in (1, 2, 3)])
    got = {r["experiment_id"]: r["job_count"] for r in as_dicts(views.experiment_summary(l))}
    hot, own = {j["id"] for j in jobs if j["run_id"] == "hot"}, {j["id"] for j in jobs if j["experiment_id"] == "e1"}
    assert got == {"e1": len(hot | own), "e2": len(hot), "e3": len(hot)}
    assert as_dicts(views.jobs_with_recovery(l), "job_id")["j000"]["success_descendant_id"] == "j299"
    assert l.as_of == NOW


@pytest.mark.skipif(not Path(TABLES).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for path in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cur = con.execute(oracle_queries()[name])
    names = [d[0] for d in cur.description]
    df = spark_queries()[name](spark, TABLES)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.skipif(not Path(TABLES).exists(), reason="test tables not present")
def test_line_items_are_joined_and_numbered_once(spark):
    tables = project(spark, TABLES).tables
    for name in ("jobs", "artifacts", "metrics", "job_runs", "man_jobs"):
        text = plan_text(tables[name])
        assert "Window" not in text and "Join" not in text, name


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select(F.col("id").alias("row_index"), F.when(F.col("id") % 40 == 0, F.concat(F.lit("k"), (F.col("id") % 80).cast("string"))).alias("k"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("k2"))
    side = spark.createDataFrame([("k0", "x", 1), ("k0", "x", 2), ("k40", "y", 3), (None, "x", 4)], "k string, k2 string, v int")
    kept = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        for on in (["k"], ["k", "k2"]):
            right = side.select(*on, "v")
            out = left_by_key(rows, right, on, ["row_index"])
            key = lambda r: repr(sorted(r.asDict().items()))
            assert sorted(out.collect(), key=key) == sorted(rows.join(right, on, "left").select(*out.columns).collect(), key=key)
            parts = out.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
            assert len(parts) > 1 and max(r["count"] for r in parts) < 2500
    finally:
        for n, value in kept.items():
            spark.conf.set(n, value)


def test_local_path_of_odd_uris(spark):
    uris = [None, "", ":", "a:b", "file:", "FILE:///a%20b//", "file://h/p?q#f", "fi le:/x", "1a:b", "C:\\u", "/abs/x:y", "rel/a", "é:x", ":x", "file", "-f:x", "s3://b/k", "File:x+y", "a\n:b"]
    u = F.col("u")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    file_path = F.try_url_decode(F.replace(F.regexp_replace(F.regexp_extract(u, r"^[^:]+:(?://[^/?#]*)?([^?#]*)", 1), "/+$", "/"), F.lit("+"), F.lit("%2B")))
    rows = spark.createDataFrame([(x,) for x in uris], "u string").select("u", tx.local_path(u).alias("got"), F.when(scheme == "file", file_path).when(scheme == "", u).alias("want")).collect()
    assert [(r["u"], r["got"]) for r in rows] == [(r["u"], r["want"]) for r in rows]
