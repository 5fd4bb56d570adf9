"""CSV and JSON files read in splits of a few bytes against readers of the whole file."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from runledger.sources import ingest, splitting, store


@pytest.fixture(params=[350, 1 << 20])
def small_splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 64)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_states_follow_the_csv_module():
    rnd = random.Random(4)
    for _ in range(4000):
        text = "".join(rnd.choice('a",\n') for _ in range(rnd.randint(0, 14)))
        lines, quoted, records = text.split("\n"), False, 0
        for line in lines:
            quoted = splitting._quoted_after(line, quoted)
            records += not quoted
        assert records + quoted == len(list(csv.reader(io.StringIO(text + ("" if text and not text.endswith("\n") else "\n"), newline="")))) , repr(text)


def test_csv_in_splits(spark, tmp_path, small_splits):
    rnd, rows = random.Random(1), []
    for k in range(40):
        rows.append([f"r{k}", rnd.choice(["loss", 'quoted "name"', "two\nlines", "x" * 90 + "\n" + '"' * 3 + "\n\n,", ""]), str(k), rnd.choice(["", "é\n日本", "a,b"])])
    path = tmp_path / "m.csv"
    with path.open("w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\r\n").writerows([["run_id", "metric_name", "value", "split"], *rows[:20], [], *rows[20:], ["short", "m"], ["a", "b", "1", "", "surplus"], ["st", 'ray"quote']])
    df, names = splitting.read_csv(spark, str(path))
    got = [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["row_index"])]
    with path.open(newline="", encoding="utf-8") as f:
        want = list(csv.DictReader(f))
    assert names == ["run_id", "metric_name", "value", "split"]
    assert [g[1:] for g in got] == [tuple(w[n] for n in names) for w in want] and len({g[0] for g in got}) == len(want)
    if small_splits < 1000:
        records = splitting.read_csv_records(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4 and records.count() == len(want) + 2
    assert ingest.read_metrics_csv(spark, str(path)).count() == len(want)


def documents(rnd):
    def value(depth):
        pick = rnd.randint(0, 7 if depth < 3 else 4)
        return [1.5, None, 'br}a{ce "q" \\ ] [ , : \\"', "", True, lambda: [value(depth + 1) for _ in range(rnd.randint(0, 3))],
                lambda: {rnd.choice(["a", "b}", 'q"', "jobs"]): value(depth + 1) for _ in range(rnd.randint(0, 3))}, "é日本" * 9][pick]
    def whole(v): return whole(v()) if callable(v) else [whole(x) for x in v] if isinstance(v, list) else {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else v  # noqa: E704
    return whole([value(0) for _ in range(rnd.randint(0, 12))])


def test_json_in_splits(spark, tmp_path, small_splits):
    rnd, want = random.Random(3), {}
    for n in range(4):
        doc = documents(rnd) if n % 2 else {"meta": {"x": [1, {"jobs": 2}]}, "jobs": documents(rnd), "none": None, "note": "plain", "runs": documents(rnd), "empty": []}
        text = json.dumps(doc, indent=rnd.choice([None, 1]), ensure_ascii=False) + rnd.choice(["", "\n", "  \n"])
        (tmp_path / f"{n}.json").write_text(text, encoding="utf-8")
        for key, items in ([(None, doc)] if n % 2 else [(k, v) for k, v in doc.items() if isinstance(v, list)]):
            for k, item in enumerate(items):
                want[f"{n}.json", key, k] = item
    elements, members = splitting.read_json_elements(spark, str(tmp_path))
    got = {(r["file"].rsplit("/", 1)[1], r["key"], r["nth"]): json.loads(r["text"]) for r in elements.collect()}
    assert got == want
    kinds = sorted({(r["key"], r["kind"]) for r in members.filter("file LIKE '%/2.json'").collect()})
    assert kinds == [("empty", "list"), ("jobs", "list"), ("meta", "object"), ("none", "value"), ("note", "value"), ("runs", "list")]


def test_wrong_documents(spark, tmp_path, small_splits):
    for k, text in enumerate(['{"jobs": [{"a": 1}', '[{"a": 1}]]', '"text"', "5", '{"jobs": [{"a": "x}]}', '[1, 2', '{"jobs": [1]', '{"runs": [1]}', '{"jobs": {"a": 1}}']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        with pytest.raises(ingest.IngestFailure):
            ingest.read_json_rows(spark, str(path), "jobs").collect()
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"jobs": [{"id": "a"}, 5, {"id": "b", "x": "}" * 50}]}))
    assert [r["row_index"] for r in sorted(ingest.read_json_rows(spark, str(good), "jobs").collect(), key=lambda r: r["row_index"])] == [0, 1, 2]
    assert ingest.ingest_scheduler_jobs(ingest.read_json_rows(spark, str(good), "jobs")).skipped.count() == 3
    manifest = store.load_manifest_json(spark, str(good))
    assert list(manifest) == ["jobs"] and manifest["jobs"].count() == 3
