from __future__ import annotations

import json
from datetime import timedelta

import pytest

from runledger.operators import reconcile as rc
from tests.conftest import NOW, as_dicts


def frame(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = {"row_index": "bigint", "errata": "boolean", "_present": "array<string>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in ["row_index", *names])
    return spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], schema)


@pytest.fixture()
def man(spark):
    return lambda **sections: {s: frame(spark, rows) for s, rows in sections.items()}


def ops(plan):
    return {(r["section"], r["entity_id"]): r["action"] for r in plan.operations.collect()}


def test_apply_twice_is_noop_and_dry_run_equals_plan(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}])
    m = man(runs=[{"id": "r1", "name": "run", "external_system": "wandb", "external_id": "x1", "attrs_json": '{"a.b": 1}'}],
            jobs=[{"id": "j1", "run_id": "r1", "status": "running", "external_system": "iris", "external_id": "/j/1"}],
            job_runs=[{"job_id": "j1", "run_id": "r1", "role": "train", "status": "running"}],
            artifacts=[{"id": "a1", "type": "checkpoint", "uri": "gs://b/c", "run_id": "r1"}],
            metrics=[{"run_id": "r1", "metric_name": "eval/loss", "value": "1.5"}], notes=[{"id": "n1", "entity_type": "experiment", "entity_id": "e1", "note_type": "debug", "body": "b"}],
            validations=[{"entity_type": "experiment", "entity_id": "e1", "check_name": "check.a", "status": "pass", "details_json": '{"k": 1}'}],
            sync_events=[{"target_system": "iris", "target_identifier": "/j/1", "status": "synced", "idempotency_key": "k1"}])
    dry, same = rc.reconcile(l, m, "test", apply=False, experiment_id="e1")
    assert same is l
    assert set(ops(dry).values()) == {"insert", "sync_event"}
    first, after = rc.reconcile(l, m, "test", apply=True, experiment_id="e1")
    assert ops(first) == ops(dry)
    assert as_dicts(after.table("experiment_runs"))[0]["run_id"] == "r1"
    log = as_dicts(after.table("reconcile_operations"))
    assert sorted(r["op_index"] for r in log) == list(range(len(log)))
    counts = json.loads(as_dicts(after.table("reconcile_events"))[0]["counts_json"])
    assert counts["total"] == 8 and counts["sync_event"] == 1
    again = rc.plan(after, m, "e1")
    assert set(ops(again).values()) == {"noop"}


def test_updates_keep_absent_fields_and_replace_attrs(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "queued", "command": "run", "attrs_json": '{"a.b":1}'}])
    p, after = rc.reconcile(l, man(jobs=[{"id": "j1", "status": "running"}, {"id": "j1", "launcher": "x", "attrs_json": '{"c.d":2}'}]), "t", apply=True)
    row = as_dicts(after.table("jobs"), "id")["j1"]
    assert (row["status"], row["command"], row["launcher"], row["attrs_json"]) == ("running", "run", "x", '{"c.d":2}')
    assert as_dicts(p.operations.filter("row_index = '0'"))[0]["diff_json"] == '{"status":["queued","running"]}'


def test_external_rows_fold(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}])
    m = man(runs=[{"name": "first", "description": "old", "external_system": "wandb", "external_id": "x"}, {"name": "second", "external_system": "wandb", "external_id": "x"}])
    p, after = rc.reconcile(l, m, "t", apply=True, experiment_id="e1")
    rows = as_dicts(after.table("runs"))
    assert [(r["name"], r["description"]) for r in rows] == [("second", "old")]
    assert p.operations.count() == 1


def test_explicit_null_is_a_lasting_diff(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "failed", "failure_reason": "boom"}])
    m = man(jobs=[{"id": "j1", "failure_reason": None, "status": "failed", "_present": ["id", "failure_reason", "status"]}])
    p, after = rc.reconcile(l, m, "t", apply=True)
    assert ops(p) == {("jobs", "j1"): "update"}
    assert as_dicts(after.table("jobs"))[0]["failure_reason"] == "boom"
    assert ops(rc.plan(after, m)) == {("jobs", "j1"): "update"}


def test_any_error_stops_everything(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}])
    m = man(runs=[{"id": "r1", "name": "ok"}], jobs=[{"id": "j1", "status": "nonsense"}])
    with pytest.raises(rc.ReconcileError):
        rc.reconcile(l, m, "t", apply=True, experiment_id="e1")


def test_archive_revive_and_immutable_role(make_ledger, man):
    old = NOW - timedelta(days=1)
    l = make_ledger(experiments=[{"id": "e1"}], runs=[{"id": "r1"}], jobs=[{"id": "j1", "status": "failed"}, {"id": "j2", "status": "failed", "deleted_at": old}],
                    job_runs=[{"job_id": "j1", "run_id": "r1", "role": "train", "status": "failed", "deleted_at": old}])
    p, after = rc.reconcile(l, man(jobs=[{"id": "j2", "op": "archive"}], runs=[{"id": "r1", "op": "archive"}], job_runs=[{"job_id": "j1", "run_id": "r1", "role": "train", "status": "failed"}]), "t", apply=True)
    assert ops(p) == {("jobs", "j2"): "noop", ("runs", "r1"): "archive", ("job_runs", "j1:r1"): "update"}
    assert as_dicts(after.table("runs"))[0]["status"] == "archived" and as_dicts(after.table("job_runs"))[0]["deleted_at"] is None
    bad = rc.plan(l, man(job_runs=[{"job_id": "j1", "run_id": "r1", "role": "eval"}], jobs=[{"id": "zz", "op": "archive"}, {"id": "j1", "op": "delete"}]))
    assert {r["error"] for r in bad.errors.collect()} == {"job-run role cannot change", "row to archive not found", "delete is not supported; use archive"}


def test_errata_on_archived_experiment(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1", "status": "archived", "deleted_at": NOW}, {"id": "e2"}],
                    artifacts=[{"id": "a1", "uri": "gs://b/x", "type": "report", "experiment_id": "e1", "run_id": None, "job_id": None}])
    row = {"type": "report", "uri": "gs://b/x", "experiment_id": "e1"}
    assert rc.plan(l, man(artifacts=[row])).errors.count() == 1
    p, after = rc.reconcile(l, man(artifacts=[{**row, "errata": True}]), "t", apply=True)
    assert list(ops(p).values()) == ["errata_replace"]
    rows = as_dicts(after.table("artifacts"), "id")
    assert rows["a1"]["deleted_at"] == NOW
    new = next(r for k, r in rows.items() if k != "a1")
    attrs = json.loads(new["attrs_json"])
    assert attrs["ledger.erratum"] is True and attrs["ledger.replaces"] == "a1"
    assert {(r["section"], r["action"]): r["n"] for r in p.counts().collect()} == {("artifacts", "insert"): 1, ("artifacts", "archive"): 1}
    foreign = rc.plan(l, man(artifacts=[{**row, "experiment_id": "e2", "errata": True}]))
    assert [r["error"] for r in foreign.errors.collect()] == ["artifact URI already belongs to other experiments"]


def test_custom_attributes_merge_last_wins(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1", "attrs_json": '{"a.b":1,"keep.me":"x"}'}])
    m = man(custom_attributes=[{"entity_type": "experiment", "entity_id": "e1", "attrs_json": '{"a.b": 2, "n.o": [1]}'}, {"entity_type": "experiment", "entity_id": "e1", "attrs_json": '{"a.b": 3}'}])
    _p, after = rc.reconcile(l, m, "t", apply=True)
    assert as_dicts(after.table("experiments"))[0]["attrs_json"] == '{"a.b":3,"keep.me":"x","n.o":[1]}'


def test_retry_graph_over_ledger_and_manifest(make_ledger, man):
    l = make_ledger(jobs=[{"id": "j1", "status": "failed", "retry_of": "j2"}, {"id": "j2", "status": "failed"}])
    errors = {r["error"] for r in rc.plan(l, man(jobs=[{"id": "j2", "status": "failed", "retry_of": "j1"}])).errors.collect()}
    assert errors == {"retry lineage would form a cycle"}
    # a manifest row without retry_of clears the parent for the check
    assert rc.plan(l, man(jobs=[{"id": "j1", "status": "failed"}, {"id": "j2", "status": "failed", "retry_of": "j1"}])).errors.count() == 0
    assert rc.plan(l, man(jobs=[{"id": "j3", "status": "queued", "retry_of": "j3"}])).errors.count() == 1


def test_metric_duplicates_in_one_manifest_are_errors(make_ledger, man):
    l = make_ledger(runs=[{"id": "r1"}])
    m = man(metrics=[{"run_id": "r1", "metric_name": "m", "value": "1"}, {"run_id": "r1", "metric_name": "m", "value": "2"}])
    assert [r["error"] for r in rc.plan(l, m).errors.collect()] == ["duplicate key in manifest"]


def test_long_note_bodies_are_logged_short(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}])
    p = rc.plan(l, man(notes=[{"id": "n1", "entity_type": "experiment", "entity_id": "e1", "note_type": "debug", "body": "y" * 5000}]))
    logged = json.loads(p.operations.first()["input_json"])["body"]
    assert logged["byte_count"] == 5000 and logged["preview"] == "y" * 200 and len(logged["sha256"]) == 64


def test_reuse_of_external_id_after_archive(make_ledger, man):
    from runledger.operators import audit
    l = make_ledger(experiments=[{"id": "e1"}], runs=[{"id": "r1", "external_system": "wandb", "external_id": "x", "deleted_at": NOW}])
    p, after = rc.reconcile(l, man(runs=[{"id": "r2", "name": "new", "external_system": "wandb", "external_id": "x"}]), "t", apply=True)
    assert ops(p) == {("runs", "r2"): "insert"}
    assert [r["code"] for r in audit.run_audit(after, ["external-ids"]).collect()] == ["external_id.duplicate_archived"]


def test_experiments_are_looked_up_before_the_ledger_rows_are_joined(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}, {"id": "e2", "deleted_at": NOW}], jobs=[{"id": "j1", "status": "failed"}])
    m = man(jobs=[{"id": "j1", "status": "killed"}, {"id": "j2", "status": "failed", "experiment_id": "e1"}, {"id": "j3", "status": "failed", "experiment_id": "e2"},
                  {"id": "j1", "status": "failed", "experiment_id": "e3"}])["jobs"]
    df = rc.plan_jobs(l, m)
    assert {r["row_index"]: (r["action"], r["error"]) for r in as_dicts(df)} == {
        0: ("update", None), 1: ("insert", None), 2: ("insert", "experiment is archived and cannot be reconciled"), 3: ("update", "experiment not found")}
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = next(k for k, x in enumerate(lines) if "Join LeftOuter" in x and "experiment_id" in x)
    end = next((k for k in range(at + 1, len(lines)) if depth[k] <= depth[at]), len(lines))
    assert not any("old#" in x for x in lines[at:end])
