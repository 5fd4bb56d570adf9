from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import pytest

from runledger.llm import common, linededup

from .helpers import EDGES, frame, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def changed(rnd, text, n):
    for _ in range(n):
        at = rnd.randrange(len(text) or 1)
        text = rnd.choice([text[:at] + rnd.choice("abz🙂") + text[at:], text[:at] + text[at + 1:], text[:at] + rnd.choice("xyé") + text[at + 1:]])
    return text


def test_band_is_the_edit_distance():
    rnd = random.Random(1)
    left = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    right = [changed(rnd, t, rnd.randint(0, 4)) if t and rnd.random() < .9 else "ab" * rnd.randint(0, 4) for t in left]
    for edits in (1, 2, 3):
        got = linededup.within(left, right, edits)
        assert got.tolist() == [distance(a, b) <= edits for a, b in zip(left, right, strict=True)]


def line_corpus():
    rnd, base = random.Random(7), [" ".join(prose(k, 12).split()) for k in range(40)]
    docs = []
    for d in range(60):
        own = [changed(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(1, 5))]
        docs.append((d * 7 % 61, "\n".join([*own, "short", ""])))
    docs += [(200 + k, f"item number {k:04d} of this very common template line\nshort") for k in range(90)]
    return docs + EDGES + [(300, "y" * 20), (301, "y" * 21), (302, "y" * 19), (303, "y" * 23), (None, "y" * 20 + "\n")]


def brute(docs):
    docs = list(dict.fromkeys(docs))
    lines = sorted({x for _, t in docs for x in (t or "").split("\n") if len(x) >= 20})
    up, near = {x: x for x in lines}, defaultdict(set)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                near[a].add(b)
                near[b].add(a)
                up[root(a)] = root(b)
    count, members = defaultdict(int), defaultdict(list)
    for d, t in docs:
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= 20:
                count[x] += 1
                members[root(x)].append((d, k))
    return docs, root, {x: count[x] - 1 + sum(count[y] for y in near[x]) for x in lines}, members


@pytest.mark.parametrize("limits", [{}, {"PAIRED": 4, "BLOCK_LINES": 8}])
def test_links_and_duplicates_match_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
    docs, root, links, members = brute(line_corpus())
    got = {(r.doc_id, r.n_lines): r for r in linededup.deduplicate(frame(spark, line_corpus()).repartition(3)).collect()}
    assert len(got) == len(docs)
    classes = defaultdict(set)
    for d, t in docs:
        own = (t or "").split("\n")
        r = got[d, len(own)]
        assert r.n_links == sum(links[x] for x in own if len(x) >= 20), d
        assert [c is None for c in r.line_classes] == [len(x) < 20 for x in own]
        for x, c in zip(own, r.line_classes, strict=True):
            if c is not None:
                classes[root(x)].add(c)
        # the first place of each class stays
        first = lambda x: min(members[root(x)], key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        assert r.removed == [k for k, x in enumerate(own) if len(x) >= 20 and first(x) != (d, k)], d
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_empty_tables(spark):
    assert linededup.deduplicate(frame(spark, [])).count() == 0


def short_corpus():
    rnd, docs = random.Random(5), [(k, f"menu\n{'ab' * 9}\n\n  \nown {k}\nmenu") for k in range(6)]
    base = ["y" * 20, "a line of twenty ch!", "some nineteen chars", "eighteen chars now", "seventeen chars x"]
    docs += [(20 + k, "\n".join(changed(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2])) for _ in range(4))) for k in range(40)]
    return docs + [(80, "z" * 19 + "\n" + "w" * 18), (81, "z" * 20 + "\n" + "w" * 20), (82, "v" * 18), (83, "v" * 19), (None, "menu")]


@pytest.mark.parametrize("limits", [{}, {"PAIRED": 2, "BLOCK_LINES": 4}])
def test_short_lines_have_classes(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
    docs = short_corpus()
    at = sorted(((d, k, x) for d, t in docs for k, x in enumerate(t.split("\n")) if x.strip()), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    near = lambda x, y: x == y or max(len(x), len(y)) >= 20 and distance(x, y) <= 2
    texts = sorted({x for _, _, x in at})
    up = {x: x for x in texts}
    for x in texts:
        for y in texts:
            if near(x, y):
                a, b = up[x], up[y]
                up = {t: a if r == b else r for t, r in up.items()}
    got = {r.doc_id: r for r in linededup.deduplicate(frame(spark, docs).repartition(3), least=1).collect()}
    for d, t in docs:
        own, r = t.split("\n"), got[d]
        assert [c is None for c in r.line_classes] == [not x.strip() for x in own]
        assert r.n_links == sum(near(x, y) for x in own if x.strip() for _, _, y in at) - sum(bool(x.strip()) for x in own)
        assert r.removed == [k for k, x in enumerate(own) if x.strip() and next(p[:2] for p in at if up[p[2]] == up[x]) != (d, k)], d
    assert got[0].removed == [0, 5] and got[5].removed == [0, 1, 5] and got[81].removed == [0, 1] and got[83].removed == []


def test_query_and_pipeline_take_short_lines(spark, tmp_path):
    from corpus_pipeline import line_dedup
    from runledger.llm.queries import op2_line_dedup
    df = frame(spark, [(1, "menu\nfirst"), (2, "menu\nsecond")])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed_lines for r in op2_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0"}
    assert {r.doc_id: r.text for r in line_dedup(spark, df.withColumn("n_chars", df.n_chars.cast("long")), str(tmp_path)).collect()} == {1: "menu\nfirst", 2: "second"}


def test_a_chunk_of_lines_takes_bounded_memory(monkeypatch):
    monkeypatch.setattr(common, "_powers", {})
    texts = [f"{i:050d}" for i in range(linededup.CHUNK // 50)]
    tracemalloc.start()
    try:
        keys = linededup.segment_keys(texts)[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(keys) >= len(texts) * 9
    assert peak < 40 << 20


def test_lines_of_documents_longer_than_a_slice(spark):
    long = "\n".join(f"line {i % 7} of a long document" for i in range(40_000)) * 2
    docs = frame(spark, [(1, long), (2, None), (3, ""), (4, "a\n" + "x" * 30), (5, long)])
    rows = linededup.split_lines(docs.coalesce(1), 1)
    got = {r[0]: r[1] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {1: 79_999, 2: 1, 3: 1, 4: 2, 5: 79_999}
    assert rows.where("text IS NOT NULL").select("id", "text").distinct().count() == rows.where("length(text) >= 18").select("text").distinct().count()
