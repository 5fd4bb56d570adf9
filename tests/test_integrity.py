"""References, unique keys and retry faults that a manifest would cause."""

from __future__ import annotations

import pytest

from runledger.operators import reconcile as rc
from runledger.operators.graph import retry_roots
from tests.conftest import NOW, as_dicts
from tests.test_reconcile import frame


@pytest.fixture()
def man(spark):
    return lambda **sections: {s: frame(spark, rows) for s, rows in sections.items()}


def errors(plan):
    return sorted((r["section"], r["row_index"], r["error"]) for r in plan.errors.collect())


def test_references_need_a_row_in_the_ledger_or_the_manifest(make_ledger, man):
    l = make_ledger(experiments=[{"id": "e1"}], runs=[{"id": "r1"}, {"id": "r_old", "deleted_at": NOW}], jobs=[{"id": "j1", "run_id": "lost"}])
    m = man(runs=[{"id": "r2", "name": "n"}], jobs=[{"id": "j1", "status": "failed"}, {"id": "j2", "run_id": "r2"}, {"id": "j3", "run_id": "nowhere"}, {"id": "j1", "run_id": "r9"}],
            metrics=[{"run_id": "missing_run", "metric_name": "a", "value": "1"}, {"run_id": "r_old", "metric_name": "a", "value": "1", "source_job_id": "j2", "source_artifact_id": "a9"}],
            job_runs=[{"job_id": "j2", "run_id": "r2"}, {"job_id": "zz", "run_id": "r1"}], sync_events=[{"target_system": "t", "status": "synced", "run_id": "r1", "job_id": "j9"}],
            artifacts=[{"id": "a1", "type": "log", "uri": "u", "job_id": "j0"}],
            validations=[{"entity_type": "run", "entity_id": "r1", "check_name": "c", "status": "pass", "session_id": "s9"}])
    assert errors(rc.plan(l, m)) == sorted([
        ("jobs", "2", "run_id names no row of runs"), ("jobs", "3", "run_id names no row of runs"), ("metrics", "0", "run_id names no row of runs"),
        ("metrics", "1", "source_artifact_id names no row of artifacts"), ("job_runs", "1", "job_id names no row of jobs"), ("sync_events", "0", "job_id names no row of jobs"),
        ("artifacts", "0", "job_id names no row of jobs"), ("validations", "0", "session_id names no row of sessions")])
    with pytest.raises(rc.ReconcileError):
        rc.reconcile(l, man(metrics=[{"run_id": "missing_run", "metric_name": "a", "value": "1"}]), "t", apply=True)


def test_keys_stay_unique_among_active_rows(make_ledger, man):
    job = {"external_system": "s", "status": "failed"}
    l = make_ledger(runs=[{"id": "r1"}], jobs=[{"id": "j1", "external_id": "a", **job}, {"id": "j2", "external_id": "b", **job}, {"id": "j3", "external_id": "c", "deleted_at": NOW, **job}, {"id": "j4", **job}],
                    artifacts=[{"id": "a1", "uri": "u1", "run_id": "r1"}, {"id": "a2", "uri": "u2", "run_id": "r1"}], sync_events=[{"id": "s1", "status": "synced"}])
    def plan(**m): return errors(rc.plan(l, man(**m)))  # noqa: E704
    taken = "external_system/external_id is taken by an active row"
    assert plan(jobs=[{"id": "j2", "external_system": "s", "external_id": "a"}]) == [("jobs", "0", taken)]
    assert plan(jobs=[{"id": "j2", "external_system": "s", "external_id": "c"}]) == []
    # the holder gives its key up, by another key or by being archived
    assert plan(jobs=[{"id": "j2", "external_system": "s", "external_id": "a"}, {"id": "j1", "external_system": "s", "external_id": "b"}]) == []
    assert plan(jobs=[{"id": "j2", "external_system": "s", "external_id": "a"}, {"id": "j1", "op": "archive"}]) == []
    assert plan(jobs=[{"id": "j3", "external_system": "s", "external_id": "a"}]) == []
    assert plan(jobs=[{"id": "j4", "external_id": "z"}, {"id": "j1", "external_system": "s", "external_id": "z"}]) == [("jobs", "0", "external_system/external_id is given to several rows")]
    assert plan(artifacts=[{"id": "a1", "type": "log", "uri": "u2", "run_id": "r1"}]) == [("artifacts", "0", "uri is taken by an active row")]
    assert plan(sync_events=[{"id": "s1", "target_system": "t", "status": "synced"}]) == [("sync_events", "0", "id is taken")]
    assert plan(artifacts=[{"id": "a2", "type": "log", "uri": "u1", "run_id": "r1", "errata": True}]) == [("artifacts", "0", "uri is taken by an active row")]


def test_only_faults_of_the_manifest_are_errors(make_ledger, man):
    rows = [("j1", None), ("j2", "j1"), ("j3", "j2"), ("k1", "k2"), ("k2", "k1"), ("k3", "k1"), ("d1", "nobody"), ("m1", "m1"), ("x1", None)]
    l = make_ledger(jobs=[{"id": i, "status": "failed", "retry_of": p} for i, p in rows])
    def faults(*jobs): return [(r["job_id"], r["error"]) for r in sorted(rc.manifest_retry_errors(l, rc.plan_jobs(l, man(jobs=list(jobs))["jobs"])).collect())]  # noqa: E704
    standing = sorted((r["job_id"], r["error"]) for r in rc.validate_retry_graph(l).collect())
    assert standing == [("d1", rc.NO_TARGET), ("k1", rc.RING), ("k2", rc.RING), ("m1", rc.SELF_RETRY)]
    assert faults({"id": "x1", "status": "queued"}, {"id": "n1", "retry_of": "j3"}, {"id": "n2", "retry_of": "n1"}) == []
    assert faults({"id": "j1", "retry_of": "j3"}) == [("j1", rc.RING), ("j2", rc.RING), ("j3", rc.RING)]
    assert faults({"id": "n1", "retry_of": "k3"}) == []  # hangs below a ring that was there before
    assert faults({"id": "n1", "retry_of": "n2"}, {"id": "n2", "retry_of": "n1"}) == [("n1", rc.RING), ("n2", rc.RING)]
    assert faults({"id": "n1", "retry_of": "gone"}, {"id": "n2", "retry_of": "n2"}) == [("n1", rc.NO_TARGET), ("n2", rc.SELF_RETRY)]
    assert faults({"id": "j2", "op": "archive"}) == [("j3", rc.NO_TARGET)]
    assert faults({"id": "j2", "op": "archive"}, {"id": "j3", "status": "failed"}) == []
    assert faults({"id": "j2", "op": "archive"}, {"id": "j1", "retry_of": "j3"}) == [("j3", rc.NO_TARGET)]
    assert faults({"id": "nobody", "status": "failed", "retry_of": "d1"}) == [("d1", rc.RING), ("nobody", rc.RING)]
    assert faults({"id": "k1", "status": "failed", "retry_of": "j3"}, {"id": "j1", "status": "failed", "retry_of": "k2"}) == [(i, rc.RING) for i in ("j1", "j2", "j3", "k1", "k2")]


def test_tree_index(make_ledger):
    rows = [("a", None), *[(f"c{k}", "a" if k == 0 else f"c{k - 1}") for k in range(20)], ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t", "r2"), ("s", "s"), ("u", "s"), ("d", "none"), ("dd", "d")]
    l = make_ledger(jobs=[{"id": i, "status": "failed", "retry_of": p} for i, p in rows])
    roots = {r["id"]: r["root"] for r in as_dicts(retry_roots(l))}
    assert roots == {**{f"c{k}": "a" for k in range(20)}, **dict.fromkeys(["r1", "r2", "r3", "t"], "r1"), "s": "s", "u": "s", "dd": "d"}


def test_a_manifest_without_jobs_starts_no_graph_work(make_ledger, man, monkeypatch):
    monkeypatch.setattr(rc, "cycle_members", lambda edges: pytest.fail("graph walk"))
    l = make_ledger(runs=[{"id": "r1"}], jobs=[{"id": "j1", "status": "failed", "retry_of": "j1"}])
    assert errors(rc.plan(l, man(metrics=[{"run_id": "r1", "metric_name": "m", "value": "1"}]))) == []
    assert errors(rc.plan(l, man(jobs=[{"id": "j2", "status": "failed"}]))) == []
    assert "retry_roots" not in l.memo
