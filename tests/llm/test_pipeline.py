from __future__ import annotations

import corpus_pipeline
from corpus_pipeline import STAGES

from . import test_op1_op9, test_op2, test_op4
from .helpers import EDGES, frame, prose
from .test_op3_op7 import check_packing


def flat(seed, n):
    return " ".join(prose(seed, n).split())


def corpus():
    shared = "this licence line is found in very many documents"
    docs = [(k, "\n".join([flat(k, 60), flat(300 + k, 30), shared])) for k in range(30)]
    docs += [(100 + k, docs[k][1]) for k in range(5)]
    docs += [(150, test_op4.edited(flat(3, 60) + " " + flat(303, 30), 1, 1)), (151, flat(3, 60) + " " + flat(303, 30))]
    docs += [(160, flat(900, 40) + " " + flat(901, 14) + " " + flat(902, 30)), (161, "spam spam " * 60), (162, "few words")]
    return docs + EDGES


def test_stages_match_brute_force(spark, tmp_path):
    docs, items = corpus(), [(1, flat(901, 14)), (2, flat(950, 20))]
    assert [n for n, _ in STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")

    want = [(d, t) for d, t in docs if not (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(test_op1_op9.brute_counts(t))]
    got = STAGES[0][1](spark, df, str(tmp_path))
    assert got.columns == df.columns and sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)

    unique, root, _, members = test_op2.brute(want)
    step = []
    for d, t in want:
        first = lambda x: min(members[root(x)], key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        own = t.split("\n")
        left = [x for k, x in enumerate(own) if len(x) < 20 or first(x) == (d, k)]
        if len(left) == len(own) or "".join(left).strip():
            step.append((d, "\n".join(left)))
    got = STAGES[1][1](spark, frame(spark, want).select(*df.columns), str(tmp_path))
    assert got.columns == df.columns and sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(step, key=key)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert len(step) < len(want)

    step += [(170, flat(3, 60) + " " + flat(303, 30)), (171, step[4][1]), step[6]]  # copies that a single stage may meet
    classes = dict((d, c) for d, _, c in test_op4.brute(list(dict.fromkeys(step))))
    got = STAGES[2][1](spark, frame(spark, step).select(*df.columns), str(tmp_path))
    want = [(d, t) for d, t in dict.fromkeys(step) if classes[d] == d]
    assert got.columns == df.columns and sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)

    hit = {d for d, _, n, _ in test_op1_op9.brute_hits(want, items) if n}
    got = STAGES[3][1](spark, frame(spark, want).select(*df.columns), str(tmp_path))
    want = [(d, t) for d, t in want if d not in hit]
    assert hit and got.columns == df.columns and sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(want, key=key)

    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), [(d, t) for d, t in want if d not in (170, 171)], 4096)


def test_stages_of_no_documents(spark, tmp_path):
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("documents", "doc_id long, text string, lang string, source string, n_chars long")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_that_stay_are_not_moved_by_the_near_duplicate_stage(spark, tmp_path):
    docs = [(k, flat(k, 60)) for k in range(12)]
    df = frame(spark, [*docs, (20, docs[0][1]), docs[1], (30, None)]).select("doc_id", "text", "lang", "source", "n_chars")
    got = STAGES[2][1](spark, df, str(tmp_path))
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([*docs, (30, "")])
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
