from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from runledger import schemas  # noqa: E402
from runledger.ledger import Ledger, empty_table  # noqa: E402
from runledger.session import local_session  # noqa: E402

NOW = datetime(2026, 1, 10, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, app="runledger-tests", memory="4g")


_FILL = {"name": "n", "status": "active", "kind": "datapoint", "role": "train", "code_dirty": 0, "type": "other", "uri": "gs://b/x", "metric_name": "m", "value": 1.0,
         "entity_type": "experiment", "entity_id": "e1", "note_type": "research", "body": "text", "body_format": "markdown", "check_name": "check.a", "owner_agent": "a",
         "ledger_id": "led", "agent": "a", "target_system": "wandb", "origin": "manifest", "source": "s", "stage": "reconcile", "op_index": 0, "entity": "runs", "action": "noop",
         "tag": "t", "key": "k", "id": "x", "run_id": "r", "job_id": "j", "experiment_id": "e1", "reconcile_event_id": "rec"}


def rows_to_df(spark, table: str, rows: list[dict]):
    if not rows:
        return empty_table(spark, table)
    out = []
    for row in rows:
        full = {}
        for name, kind, nullable in schemas.columns(table):
            if name in row:
                full[name] = row[name]
            elif nullable:
                full[name] = None
            elif kind == "ts":
                full[name] = NOW
            elif name.endswith("_json"):
                full[name] = "{}"
            else:
                full[name] = _FILL[name]
        unknown = set(row) - set(full)
        assert not unknown, unknown
        out.append(tuple(full[n] for n, _k, _n in schemas.columns(table)))
    return spark.createDataFrame(out, schemas.struct(table))


@pytest.fixture()
def make_ledger(spark):
    def build(as_of: datetime = NOW, inventory=None, **tables) -> Ledger:
        frames = {t: rows_to_df(spark, t, tables.pop(t, [])) for t in schemas.TABLES}
        assert not tables, tables
        if inventory is not None:
            frames["inventory"] = spark.createDataFrame(inventory, "path string, mtime double, size bigint")
        return Ledger(tables=frames, as_of=as_of, session=spark)
    return build


def as_dicts(df, key=None):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return {r[key]: r for r in rows} if key else rows
