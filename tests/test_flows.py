from __future__ import annotations

import json
import os
from datetime import timedelta

import pytest

from runledger.operators import audit, exports, freshness, reconcile as rc, writeback
from runledger.plans.flow_checks import FLOWS
from runledger.sources import ingest, store
from runledger.streaming import streams
from tests.conftest import NOW, as_dicts, rows_to_df


def test_json_adapters_clean_partial_strict_and_hard_failure(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [
        {"id": "j1", "external_id": "/a/1", "status": "running", "attrs": {"b.x": 1, "a.y": "z"}}, {"external_id": "/a/2", "status": "odd"}, 7,
        {"external_id": "", "status": "queued"}, {"external_id": "/a/3", "status": "queued", "started_at": "2026-01-01 00:00:00"}]}))
    out = ingest.ingest_scheduler_jobs(ingest.read_json_rows(spark, str(tmp_path / "jobs.json"), "jobs"))
    assert [(r["id"], r["attrs_json"]) for r in as_dicts(out.sections["jobs"])] == [("j1", '{"a.y":"z","b.x":1}')]
    assert as_dicts(out.sections["sync_events"])[0]["idempotency_key"] == "adapter:scheduler-jobs-json:iris:/a/1"
    skipped = {r["row_index"]: r["message"] for r in as_dicts(out.skipped)}
    assert set(skipped) == {1, 2, 3, 4} and skipped[2] == "source row must be an object"
    assert as_dicts(out.summary())[0]["outcome"] == "partial"
    with pytest.raises(ingest.IngestFailure):
        out.strict()
    (tmp_path / "bad.json").write_text('{"other": []}')
    with pytest.raises(ingest.IngestFailure):
        ingest.read_json_rows(spark, str(tmp_path / "bad.json"), "jobs")
    (tmp_path / "list.json").write_text('[{"id": "w1", "name": "n", "url": "http://x", "attrs": {"wandb.url": "mine"}}]')
    runs = ingest.ingest_tracker_runs(ingest.read_json_rows(spark, str(tmp_path / "list.json"), "runs"))
    assert [(r["external_id"], r["attrs_json"]) for r in as_dicts(runs.sections["runs"])] == [("w1", '{"wandb.url":"mine"}')]
    assert as_dicts(runs.strict().summary())[0]["outcome"] == "clean"


def test_source_text_is_written_out_for_skipped_rows_only(spark):
    raw = spark.createDataFrame([(0, '{"external_id":"/a/1","status":"running","attrs":{"b.x":1}}'), (1, '{"external_id":"/a/2","status":"queued","attrs":{"Bad":1}}'), (2, "[1]")],
                                "row_index long, text string")
    out = ingest.ingest_scheduler_jobs(ingest.rows_from_json_text(raw, "text", "row_index"))
    rows = as_dicts(out.rows, "row_index")
    assert [rows[k]["error"] for k in range(3)] == [None, "attribute keys must be lowercase dotted names", "source row must be an object"]
    assert rows[0]["source_row"] is None and rows[0]["attrs_json"] == '{"b.x":1}'
    assert {r["row_index"]: r["source_row"] for r in as_dicts(out.skipped)} == {1: '{"attrs":{"Bad":1},"external_id":"/a/2","status":"queued"}', 2: "[1]"}


def test_metric_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("run_id,metric_name,value,step\nr1,loss,1.5,10\nr1,loss,nan,\nr1,loss,abc,\n,loss,1,\n")
    out = ingest.ingest_metrics_csv(ingest.read_metrics_csv(spark, str(tmp_path / "m.csv")))
    assert [(r["value"], r["step"]) for r in as_dicts(out.sections["metrics"])] == [(1.5, "10")]
    assert out.skipped.count() == 3
    (tmp_path / "bad.csv").write_text("run_id,value\nr1,1\n")
    with pytest.raises(ingest.IngestFailure):
        ingest.read_metrics_csv(spark, str(tmp_path / "bad.csv"))


def test_ingest_feeds_reconcile_end_to_end(spark, make_ledger, tmp_path):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "submitting"}])
    (tmp_path / "jobs.json").write_text(json.dumps([{"id": "j1", "external_id": "/a/1", "status": "running", "started_at": "2026-01-01T00:00:00Z"}]))
    fed = ingest.ingest_scheduler_jobs(ingest.read_json_rows(spark, str(tmp_path / "jobs.json"), "jobs"))
    res = as_dicts(ingest.submission_resolutions(l, fed.sections["jobs"]))
    assert (res[0]["previous_status"], res[0]["resolved_status"], res[0]["suggested_action"]) == ("submitting", "running", "none")
    _p, after = rc.reconcile(l, fed.sections, "refresh", apply=True, experiment_id="e1")
    row = as_dicts(after.table("jobs"))[0]
    assert row["status"] == "running" and row["started_at"].year == 2026
    assert as_dicts(after.table("sync_events"))[0]["status"] == "synced"


def test_wide_export(make_ledger):
    l = make_ledger(experiments=[{"id": "e1"}], runs=[{"id": "r1"}, {"id": "r2"}], experiment_runs=[{"run_id": "r1"}, {"run_id": "r2"}],
                    jobs=[{"id": "j1", "status": "failed", "code_commit": "abc", "deleted_at": NOW}],
                    metrics=[{"id": "m1", "run_id": "r1", "metric_name": "loss", "value": 2.0, "source_job_id": "j1"}, {"id": "m2", "run_id": "r1", "metric_name": "loss", "value": 3.0, "step": "5", "split": "valid"}])
    wide = exports.export_runs_wide(l)
    assert wide.columns[6:8] == ["loss", "loss|step=5|split=valid"]
    r1 = as_dicts(wide, "run_id")["r1"]
    assert (r1["loss"], r1["loss|step=5|split=valid"], r1["loss__source_job_code_commit"]) == (2.0, 3.0, "abc")
    with pytest.raises(exports.AmbiguousExport):
        exports.export_runs_wide(l, metric_names=["loss"])
    cov = {r["metric_name"]: r["coverage"] for r in as_dicts(exports.export_coverage(l, ["loss", "missing"]))}
    assert cov == {"loss": 0.5, "missing": 0.0}


def _writer():
    def write(target, field, value):
        return (value > 1, None if value > 1 else "401 Bearer abc")
    return write


def test_writeback_plan_push_record(make_ledger):
    l = make_ledger(runs=[{"id": "r1", "external_system": "wandb", "external_id": "w1"}, {"id": "r2", "parent_run_id": "r1"}, {"id": "r3"}],
                    metrics=[{"id": "m1", "run_id": "r1", "metric_name": "eval/a", "value": 2.0}, {"id": "m2", "run_id": "r2", "metric_name": "eval/a", "value": 1.0}, {"id": "m3", "run_id": "r3", "metric_name": "eval/a"},
                             {"id": "m4", "run_id": "r1", "metric_name": "eval/b", "split": "x"}, {"id": "m5", "run_id": "r1", "metric_name": "eval/b", "split": "y"}])
    p = writeback.plan_writeback(l, ["eval/*"])
    assert {r["source_metric_id"]: r["action"] for r in p.collect()} == {"m1": "planned", "m2": "planned", "m3": "no_target", "m4": "field_collision", "m5": "field_collision"}
    assert writeback.writeback_errors(p).count() == 3
    with pytest.raises(ValueError):
        writeback.push(p, _writer)
    done = writeback.push(p, _writer, first_write_ok=True)
    after = l.with_tables(sync_events=writeback.record_results(l, done))
    events = {r["source_entity_id"]: (r["status"], r["error_message"]) for r in as_dicts(after.table("sync_events"))}
    assert events == {"m1": ("synced", None), "m2": ("failed", "401 <redacted bearer>")}
    again = {r["source_metric_id"]: r["action"] for r in writeback.plan_writeback(after, ["eval/a"]).collect()}
    assert again == {"m1": "already_synced", "m2": "planned", "m3": "no_target"}


def test_file_drift_with_real_files(spark, make_ledger, tmp_path):
    kept, changed = tmp_path / "kept.txt", tmp_path / "changed.txt"
    kept.write_text("same")
    changed.write_text("long enough")
    base = make_ledger(experiments=[{"id": "e1"}], artifacts=[{"id": k, "uri": f"file://{p}", "experiment_id": "e1", "run_id": None, "job_id": None, "updated_at": NOW - timedelta(3)} for k, p in
                                                              (("a1", kept), ("a2", changed), ("a3", tmp_path / "gone.txt"))], validations=[{"id": "v1", "source_artifact_id": "a2", "status": "pass", "updated_at": NOW}])
    seen = store.file_inventory(spark, str(tmp_path))
    l = base.with_tables(inventory=seen)
    arts = {r["id"]: r for r in as_dicts(freshness.capture_metadata(l))}
    assert set(arts) == {"a1", "a2"} and json.loads(arts["a1"]["attrs_json"])["ledger.local_size_at_capture"] == 4
    gone = {"id": "a3", "uri": "x", "attrs_json": '{"ledger.local_size_at_capture":1}', "experiment_id": "e1", "run_id": None, "job_id": None}
    captured = spark.createDataFrame([tuple(r[c] for c in l.table("artifacts").columns) for r in arts.values()], l.table("artifacts").schema).unionByName(rows_to_df(spark, "artifacts", [gone]))
    changed.write_text("short")
    os.utime(changed, (1, 1))
    later = l.with_tables(artifacts=captured, inventory=store.file_inventory(spark, str(tmp_path)))
    assert {r["artifact_id"]: r["drift_kind"] for r in as_dicts(freshness.drifted_artifacts(later))} == {"a2": "mtime_size", "a3": "missing_file"}
    assert [r["validation_id"] for r in as_dicts(freshness.stale_validations(later))] == ["v1"]
    assert as_dicts(store.file_hashes(spark, str(kept)))[0]["content_hash"].startswith("sha256:")


def test_captured_attributes_are_parsed_once(make_ledger):
    def art(key, text):
        return {"id": key, "uri": "gs://b/x", "attrs_json": text, "experiment_id": None, "run_id": None, "job_id": None}
    l = make_ledger(inventory=[("/p/1", 5.5, 7), ("/p/4", 1.0, 1)], artifacts=[
        art("a1", '{"ledger.local_path_at_capture":"/p/1","ledger.local_mtime_at_capture":5.5,"ledger.local_size_at_capture":7}'),
        art("a2", '{"ledger.local_path_at_capture":"/p/1","ledger.local_mtime_at_capture":"5.5","ledger.local_size_at_capture":7}'),
        art("a3", '{"note":"ledger.local_size_at_capture","x":{"ledger.local_size_at_capture":1}}'), art("a4", '{"ledger.local_path_at_capture":4,"ledger.local_size_at_capture":1}'),
        art("a5", 'no json "ledger.local_size_at_capture"'), art("a6", "{}")])
    df = freshness.drifted_artifacts(l)
    assert {r["artifact_id"]: (r["drift_kind"], r["path"]) for r in as_dicts(df)} == {"a2": ("mtime", "/p/1"), "a4": ("missing_file", None)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_secrets_in_refresh_files(spark, make_ledger, tmp_path):
    f = tmp_path / "snap.json"
    f.write_text("x" * 70000 + " sk-" + "a" * 24)
    l = make_ledger(refresh_events=[{"id": "f1", "status": "applied", "snapshot_path": str(f)}])
    assert as_dicts(audit.run_audit(l, checks=["privacy"])) == []
    rows = as_dicts(audit.run_audit(l.with_tables(contents=store.file_texts(spark, str(tmp_path))), checks=["privacy"]))
    assert [(r["entity_id"], json.loads(r["details"])["pattern_family"]) for r in rows] == [("f1", "openai_style_key")]


def test_store_versions_snapshot_and_restore(spark, make_ledger, tmp_path):
    root, snap = str(tmp_path / "led"), str(tmp_path / "snap")
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "status": "failed"}, {"id": "j2", "status": "failed", "deleted_at": NOW}])
    assert store.save_ledger(l, root).startswith("v000001-")
    loaded = store.load_ledger(spark, root, NOW)
    assert store.save_ledger(loaded.with_tables(jobs=loaded.active("jobs")), root, ["jobs"]).startswith("v000002-")
    assert store.load_ledger(spark, root, NOW).table("jobs").count() == 1
    assert loaded.table("jobs").count() == 2  # readers of the old version are undisturbed
    meta = store.write_snapshot(loaded, snap, ledger_id="led")
    assert meta["table_counts"]["jobs"] == 2
    with pytest.raises(store.StoreError):
        store.write_snapshot(loaded, snap)
    store.write_snapshot(loaded, snap, replace=True)
    assert store.inspect_snapshot(spark, snap)["complete"]
    with pytest.raises(store.StoreError):
        store.restore_snapshot(spark, snap, root, NOW)
    assert store.restore_snapshot(spark, snap, str(tmp_path / "other"), NOW).table("jobs").count() == 2
    (tmp_path / "snap" / "SNAPSHOT.json").write_text(json.dumps({**meta, "schema_version": 99}))
    for crc in (tmp_path / "snap").glob(".SNAPSHOT*"):
        crc.unlink()
    with pytest.raises(store.StoreError):
        store.restore_snapshot(spark, snap, str(tmp_path / "third"), NOW)


def test_a_snapshot_copies_the_rows_as_they_lie(spark, make_ledger, tmp_path):
    l = make_ledger(jobs=[{"id": f"j{k}", "status": "failed"} for k in range(9)])
    meta = store.write_snapshot(l.with_tables(jobs=l.table("jobs").repartition(3, "id")), str(tmp_path / "snap"))
    assert meta["table_counts"]["jobs"] == 9 and len(list((tmp_path / "snap" / meta["data"] / "jobs").glob("*.parquet"))) > 1
    back = store.restore_snapshot(spark, str(tmp_path / "snap"), str(tmp_path / "led"), NOW)
    assert sorted(r["id"] for r in as_dicts(back.table("jobs"))) == [f"j{k}" for k in range(9)]


def test_manifests_json_and_csv(spark, make_ledger, tmp_path):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "failed", "failure_reason": "b"}])
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"manifest_version": 1, "runs": [{"id": "r1", "name": "n", "attrs": {"a.b": [1, 2]}}], "jobs": [{"id": "j1", "failure_reason": None}, {"id": "j1", "_op": "archive"}],
                                "metrics": [{"run_id": "r1", "name": "loss", "value": 2}]}))
    m = store.load_manifest_json(spark, str(path))
    assert set(m) == {"runs", "jobs", "metrics"}
    p, after = rc.reconcile(l, m, "file", apply=True, experiment_id="e1")
    assert {(r["section"], r["action"]) for r in p.operations.collect()} == {("runs", "insert"), ("jobs", "update"), ("jobs", "archive"), ("metrics", "insert")}
    job = as_dicts(after.table("jobs"))[0]
    assert job["deleted_at"] == NOW and job["failure_reason"] == "b"
    assert as_dicts(after.table("runs"))[0]["attrs_json"] == '{"a.b":[1,2]}'
    csv = tmp_path / "m.csv"
    csv.write_text('entity_type,id,name,attrs_json,status\nrun,r9,nine,"{""x.y"":1}",\njobs,j9,,,queued\n')
    c = store.load_manifest_csv(spark, str(csv))
    assert c["runs"].count() == 1 and c["jobs"].count() == 1
    assert rc.plan(l, {k: c[k] for k in ("runs", "jobs")}, "e1").errors.count() == 0
    csv2 = tmp_path / "bad.csv"
    csv2.write_text("entity_type,id\nplanet,p1\n")
    with pytest.raises(store.StoreError):
        store.load_manifest_csv(spark, str(csv2))


def test_stream_manifests_replays_to_noop(spark, make_ledger, tmp_path):
    root, feed = str(tmp_path / "led"), tmp_path / "feed"
    feed.mkdir()
    store.save_ledger(make_ledger(experiments=[{"id": "e1"}]), root)

    def drop(name, index, row):
        (feed / name).write_text(json.dumps({"row_index": index, "text": json.dumps(row)}) + "\n")

    def run(mark):
        q = streams.stream_manifests(spark, str(feed), "scheduler-jobs-json", root, str(tmp_path / mark), NOW, "e1")
        q.awaitTermination(120)
        assert q.exception() is None

    drop("1.json", 0, {"id": "j1", "external_id": "/a/1", "status": "queued"})
    run("ck")
    drop("2.json", 1, {"id": "j1", "external_id": "/a/1", "status": "running"})
    run("ck")
    now = store.load_ledger(spark, root, NOW)
    assert [(r["id"], r["status"]) for r in as_dicts(now.table("jobs"))] == [("j1", "running")]
    version = store.stored_version(spark, root)["version"]
    run("ck")  # nothing new
    assert store.stored_version(spark, root)["version"] == version == 3
    assert now.table("sync_events").count() == 1


def test_stream_sync_dedupe(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [{"id": f"s{i}", "status": "synced", "idempotency_key": k, "target_identifier": t} for i, (k, t) in enumerate([("k", "a"), ("k", "a"), ("k", None), (None, "a"), (None, "a")])]
    rows_to_df(spark, "sync_events", rows).coalesce(1).write.parquet(src)
    q = streams.stream_sync_dedupe(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = [(r["idempotency_key"], r["target_identifier"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted([("k", "a"), ("k", None), (None, "a"), (None, "a")], key=str)


def test_wide_query_keeps_every_cell_and_links_without_any(make_ledger):
    """The registered form shows each cell's own value and sources; a link with no cell, or with clashing ones only, keeps a row."""
    l = make_ledger(experiments=[{"id": "e1"}], runs=[{"id": r} for r in ("r1", "r2", "r3")], experiment_runs=[{"experiment_id": "e1", "run_id": r} for r in ("r1", "r2", "r3")],
                    metrics=[{"id": "m1", "run_id": "r1", "metric_name": "a`b", "value": 1.5, "source_job_id": "j1"}, {"id": "m2", "run_id": "r1", "metric_name": "loss", "value": 2.25},
                             {"id": "m3", "run_id": "r2", "metric_name": "loss", "value": 1.0}, {"id": "m4", "run_id": "r2", "metric_name": "loss", "value": 2.0}])
    got = sorted((r["run_id"], r["column"], r["value"], r["source_job_id"]) for r in as_dicts(FLOWS["export_runs_wide"][0](l).filter("column IS NOT NULL")))
    assert got == [("r1", "a`b", 1.5, "j1"), ("r1", "loss", 2.25, None)]
    assert sorted(r["run_id"] for r in as_dicts(FLOWS["export_runs_wide"][0](l).filter("column IS NULL"))) == ["r2", "r3"]
