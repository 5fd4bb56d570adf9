from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from runledger.operators import audit, freshness, lifecycle, ownership, reports, views
from tests.conftest import NOW, as_dicts


def test_ten_phase_matrix(make_ledger):
    plan = {"complete": ("eval", "succeeded"), "evaluated": ("eval", "succeeded"), "failed": ("train", "failed"), "killed": ("train", "killed"), "planned": None, "skipped": ("train", "skipped"),
            "submitted": ("train", "unknown_submit"), "submitted2": ("train", "planned"), "trained": ("train", "succeeded"), "training": ("train", "running")}
    runs, jobs, edges = [], [], []
    for name, edge in plan.items():
        runs.append({"id": f"r_{name}", "experiment_id": "e1", "name": name})
        if edge:
            jobs.append({"id": f"j_{name}", "status": edge[1]})
            edges.append({"job_id": f"j_{name}", "run_id": f"r_{name}", "role": edge[0], "status": edge[1]})
    l = make_ledger(
        experiments=[{"id": "e1", "attrs_json": '{"progress.expected_runs":10,"progress.required_metrics":["eval/bpb"]}'}], runs=runs, jobs=jobs, job_runs=edges,
        artifacts=[{"id": "a1", "run_id": "r_trained", "type": "checkpoint"}, {"id": "a2", "run_id": "r_evaluated", "type": "eval-result", "uri": "gs://b/y"}],
        metrics=[{"id": "m1", "run_id": "r_complete", "metric_name": "eval/bpb"}])
    s = as_dicts(reports.run_progress_summary(l))[0]
    phases = {k[6:]: s[k] for k in s if k.startswith("phase_")}
    assert phases == {"complete": 1, "evaluated": 1, "failed": 2, "planned": 1, "skipped": 1, "submitted": 2, "trained": 1, "training": 1}
    assert (s["with_checkpoint"], s["with_eval_result"], s["expected"], s["missing_expected_count"]) == (1, 1, 10, 0)


def test_skip_beats_checkpoint(make_ledger):
    l = make_ledger(runs=[{"id": "r1"}], jobs=[{"id": "j1", "status": "skipped"}], job_runs=[{"job_id": "j1", "run_id": "r1", "role": "train", "status": "skipped"}],
                    artifacts=[{"id": "a1", "run_id": "r1", "type": "checkpoint"}], experiments=[{"id": "e1"}])
    assert as_dicts(views.runs_progress(l))[0]["phase"] == "skipped"


def test_lifecycle_precedence(make_ledger):
    def state(**tables):
        return as_dicts(lifecycle.lifecycle(make_ledger(experiments=[{"id": "e1"}], **tables)))[0]

    done = {"id": "j1", "experiment_id": "e1", "status": "succeeded", "updated_at": NOW - timedelta(hours=5)}
    assert state(jobs=[done])["lifecycle_state"] == "review"
    reviewed = {"id": "n1", "note_type": "review", "status": "resolved", "attrs_json": '{"ledger.reviewed_activity_count":1}', "created_at": NOW - timedelta(hours=1)}
    assert state(jobs=[done], notes=[reviewed])["lifecycle_state"] == "open"
    newer = {"id": "a1", "experiment_id": "e1", "run_id": None, "job_id": None, "updated_at": NOW - timedelta(hours=2)}
    assert state(jobs=[done], notes=[reviewed], artifacts=[newer])["lifecycle_state"] == "review"
    assert state(jobs=[done, {"id": "j2", "experiment_id": "e1", "status": "running"}], notes=[reviewed], artifacts=[newer])["lifecycle_state"] == "running"
    held = {"id": "l1", "heartbeat_at": NOW}
    assert state(jobs=[done], notes=[reviewed], leases=[held])["lifecycle_state"] == "open"
    assert state(jobs=[done], notes=[reviewed], leases=[{**held, "heartbeat_at": NOW - timedelta(hours=2)}])["lifecycle_state"] == "needs_attention"
    idle = state(notes=[reviewed])
    assert (idle["handoff_status"], idle["lifecycle_state"]) == ("idle", "open")


def test_job_on_two_paths_counts_once_in_each(make_ledger):
    l = make_ledger(experiments=[{"id": "e1"}, {"id": "e2"}], runs=[{"id": "r1", "experiment_id": "e1"}], experiment_runs=[{"experiment_id": e, "run_id": "r1"} for e in ("e1", "e2")],
                    jobs=[{"id": "j1", "experiment_id": "e1", "run_id": "r1", "status": "failed"}])
    rows = as_dicts(lifecycle.lifecycle(l), "experiment_id")
    assert {e: (r["job_count"], r["failed_job_count"]) for e, r in rows.items()} == {"e1": (1, 1), "e2": (1, 1)}
    summary = as_dicts(views.experiment_summary(l), "experiment_id")
    assert {e: r["job_count"] for e, r in summary.items()} == {"e1": 1, "e2": 1}


def test_redaction(make_ledger):
    uris = {"a1": "/home/u/out.json", "a2": "rel/dir/out.json", "a3": "file:///tmp/p/x.bin", "a4": "C:\\runs\\best.pt", "a5": "gs://b/k", "a6": "S3://b/k", "a7": "wandb:e/p/r", "a8": "https://h/x",
            "a9": "ftp://h/x", "b1": "plain", "b2": "/dir/", "b3": "/", "b4": "FILE:///Tmp/Y"}
    l = make_ledger(experiments=[{"id": "e1"}], artifacts=[{"id": k, "uri": u, "experiment_id": "e1", "run_id": None, "job_id": None} for k, u in uris.items()])
    got = {r["artifact_id"]: (r["uri_locality"], r["display_uri"]) for r in as_dicts(views.artifacts_redacted(l))}
    assert got == {
        "a1": ("local-fs", "local:a1/out.json"), "a2": ("local-fs", "local:a2/out.json"), "a3": ("local-fs", "local:a3/x.bin"), "a4": ("local-fs", "local:a4/best.pt"),
        "a5": ("gcs", "gs://b/k"), "a6": ("s3", "S3://b/k"), "a7": ("wandb", "wandb:e/p/r"), "a8": ("http", "https://h/x"), "a9": ("other", "ftp://h/x"),
        "b1": ("local-fs", "local:b1/plain"), "b2": ("local-fs", "local:b2/dir"), "b3": ("local-fs", "local:b3/artifact"), "b4": ("local-fs", "local:b4/Y")}


def test_previews_are_first_line_and_capped(make_ledger):
    l = make_ledger(experiments=[{"id": "e1"}], notes=[{"id": "n1", "status": "open", "body": "\n   \n  first line  \nrest"}, {"id": "n2", "status": "open", "body": "x" * 201, "updated_at": NOW - timedelta(1)}])
    got = {r["note_id"]: r["body_preview"] for r in as_dicts(reports.note_digest(l))}
    assert got == {"n1": "first line", "n2": "x" * 199 + "…"}


def test_cleanup_plan_and_apply(make_ledger):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "failed"}, {"id": "j2", "experiment_id": "e1", "status": "succeeded", "retry_of": "j1"}],
                    notes=[{"id": "n1", "entity_type": "job", "entity_id": "j1", "note_type": "debug", "status": "open"}],
                    validations=[{"id": "v1", "status": "fail", "updated_at": NOW - timedelta(2)}, {"id": "v2", "status": "pass"}])
    assert {(r["plan"], r["entity_id"]) for r in as_dicts(reports.cleanup_plan(l))} == {("debug_note", "n1"), ("superseded_validation", "v1")}
    out = reports.apply_cleanup(l)
    notes = as_dicts(out["notes"], "id")
    assert notes["n1"]["status"] == "resolved" and len(notes) == 2
    assert as_dicts(out["validations"], "id")["v1"]["deleted_at"] == NOW


def test_conflicting_leases(make_ledger):
    from runledger.operators import audit
    l = make_ledger(experiments=[{"id": "e1"}], leases=[{"id": "l1"}, {"id": "l2"}])
    codes = [r["code"] for r in as_dicts(audit.run_audit(l, checks=["leases"]))]
    assert codes == ["lease.conflicting_active"]
    ids = [r["entity_id"] for r in as_dicts(audit.run_audit(l, checks=["leases"]))]
    assert ids == ["experiment:e1"]


def test_only_failed_jobs_are_sent_to_the_retry_summary(make_ledger):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[
        {"id": "a", "status": "failed", "experiment_id": "e1"}, {"id": "b", "status": "succeeded", "retry_of": "a", "experiment_id": "e1"}, {"id": "c", "status": "failed", "experiment_id": "e1"},
        {"id": "d", "status": "failed", "experiment_id": "e1"}, {"id": "e", "status": "running", "retry_of": "d", "experiment_id": "e1"}, {"id": "f", "status": "failed", "deleted_at": NOW}])
    flags = ["is_blocking_failed", "is_recovery_in_progress", "is_recovered_failed"]
    want = {r["job_id"]: [r[c] for c in flags] for r in as_dicts(views.jobs_with_recovery(l))}
    states = views.failed_job_states(l)
    assert {r["job_id"]: [r[c] for c in flags] for r in as_dicts(states)} == want and len(want) == 5
    sides = states._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
    assert "= failed)" in sides[1]  # the jobs on its left
    row = as_dicts(lifecycle.lifecycle(l))[0]
    assert (row["job_count"], row["failed_job_count"], row["blocking_failed_job_count"], row["recovery_in_progress_failed_job_count"], row["recovered_failed_job_count"]) == (5, 3, 1, 1, 1)


def test_owners_are_looked_up_for_asked_jobs_and_artifacts_only(spark, make_ledger, monkeypatch):
    l = make_ledger(
        experiments=[{"id": f"e{i}"} for i in range(1, 5)], runs=[{"id": "r1", "experiment_id": "e2"}, {"id": "r2", "experiment_id": None}],
        experiment_runs=[{"experiment_id": "e3", "run_id": "r1"}, {"experiment_id": "e4", "run_id": "r2"}],
        jobs=[{"id": "j1", "experiment_id": "e1", "run_id": "r1"}, {"id": "j2", "run_id": "r2"}, {"id": "j3"}], job_runs=[{"job_id": "j3", "run_id": "r2"}],
        artifacts=[{"id": "a1", "job_id": "j1"}, {"id": "a2", "run_id": "r1", "experiment_id": "e4"}, {"id": "a3", "job_id": "j3"}, {"id": "a4"}],
        notes=[{"id": "n1", "entity_type": "artifact", "entity_id": "a3"}])
    named = [("job", "j1"), ("job", "j1"), ("job", None), ("job", "gone"), ("artifact", "a1"), ("artifact", "a2"), ("note", "n1"), ("run", "r1"), ("job_run", "j3:r1")]
    issues = spark.createDataFrame([("c", "error", t, i, "m", "{}", "n") for t, i in named], ", ".join(f"{c} string" for c in audit.ISSUE_COLUMNS))
    asked = []
    real = ownership.job_experiments
    for module in (audit, ownership):
        monkeypatch.setattr(module, "job_experiments", lambda led, variant="owner", only=None: (asked.append(only), real(led, variant, only))[1])
    got = sorted((r["entity_type"], r["entity_id"], r["owner_id"]) for r in audit.scope_issues(l, issues).collect())
    assert got == sorted([*[("job", "j1", e) for e in ("e1", "e2", "e3")] * 2, *[("artifact", "a1", e) for e in ("e1", "e2", "e3")],
                          *[("artifact", "a2", e) for e in ("e2", "e3", "e4")], ("note", "n1", "e4"), ("run", "r1", "e2"), ("run", "r1", "e3"),
                          *[("job_run", "j3:r1", e) for e in ("e2", "e3", "e4")]])
    assert len(asked) == 2 and None not in asked
    assert {r[0] for r in asked[0].collect() if r[0]} == {"j1", "gone", "j3"} and {r[0] for r in asked[1].collect() if r[0]} == {"j1", "j3"}


def test_plain_test_of_paths_is_the_pattern(spark):
    paths = ["/a/b", "/a/b//", "/", "//", "", None, "a/\n", "a/\r\n", "a/ ", "a/\x85", "a/ ", "\n/", "a/\n\n"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert df.where(~freshness.normal_path(F.col("p")).eqNullSafe(F.regexp_replace("p", "(?<=.)/+$", ""))).count() == 0
