"""Row identity, ids, the store after a lost writer, and SQL over the stable views."""

from __future__ import annotations

import json

import pytest

from runledger.operators import audit, reconcile, views
from runledger.sources import ingest, store
from tests.conftest import NOW, as_dicts


def jobs_manifest(spark, rows):
    return {"jobs": spark.createDataFrame(rows, "row_index long, name string, external_system string, external_id string, status string")}


def test_rows_of_two_files_stay_apart(spark, make_ledger, tmp_path):
    for name, ext in (("a", "/a/1"), ("b", "/b/2")):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"external_id": ext, "status": "succeeded", "name": name}]))
    rows = ingest.read_json_rows(spark, str(tmp_path), "jobs")
    assert rows.select("row_index").distinct().count() == 2
    l = make_ledger(jobs=[{"id": "j1", "external_system": "sched", "external_id": "/a/1", "status": "running"}])
    again = {"jobs": spark.createDataFrame([(0, "/a/1"), (0, "/b/2")], "row_index long, external_id string")}
    with pytest.raises(reconcile.ReconcileError):
        reconcile.plan(l, again)


def test_manifests_at_one_time_get_ids_of_their_own(spark, make_ledger):
    l = make_ledger()
    _, one = reconcile.reconcile(l, jobs_manifest(spark, [(0, "A", None, None, "failed")]), "s", apply=True)
    _, two = reconcile.reconcile(one, jobs_manifest(spark, [(0, "B", None, None, "failed")]), "s", apply=True)
    assert two.table("jobs").select("id").distinct().count() == 2
    assert two.table("reconcile_events").select("id").distinct().count() == 2
    assert two.table("reconcile_operations").select("id").distinct().count() == 2


def test_store_goes_on_after_a_lost_writer(spark, make_ledger, tmp_path):
    root, l = str(tmp_path / "ledger"), make_ledger(jobs=[{"id": "j1"}])
    first = store.save_ledger(l, root)
    state = store.stored_version(spark, root)
    (tmp_path / "ledger" / f"v{state['version'] + 1:06d}" / "jobs").mkdir(parents=True)  # what a dead writer left
    second = store.save_ledger(l, root, ["jobs"], expected=first)
    assert second != first and store.load_ledger(spark, root, NOW).table("jobs").count() == 1
    with pytest.raises(store.StoreError):
        store.save_ledger(l, root, ["jobs"], expected=first)


def test_sql_over_every_stable_view(spark, make_ledger):
    l = make_ledger(experiments=[{"id": "e1"}], jobs=[{"id": "j1", "experiment_id": "e1", "status": "failed"}])
    store.register_views(l, prefix="t_")
    assert len(views.STABLE) == 37
    for name in [*views.STABLE, "v_dashboard_experiments"]:
        assert spark.sql(f"SELECT count(*) FROM t_{name}").first()[0] >= 0
    assert spark.sql("SELECT status FROM t_v_jobs WHERE job_id = 'j1'").first()[0] == "failed"


def test_schema_version_mismatch(make_ledger):
    l = make_ledger(schema_metadata=[{"key": "schema_version", "value": "17"}])
    assert len(as_dicts(audit.run_audit(l, checks=["schema-version"]))) == 1
