from __future__ import annotations

import random
from collections import defaultdict

import pytest

from runledger.llm import jaccard
from runledger.llm.links import components

from .helpers import EDGES, contract_words, frame, prose


def edited(text, seed, edits):
    rnd, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"q{rnd.randrange(10**6)}"
    return " ".join(w)


def brute(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = contract_words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up, links = list(range(len(docs))), [0] * len(docs)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, links[i], min(least[root(i)], default=None)) for i, (d, _) in enumerate(docs)), key=repr)


def corpus():
    docs, k = [], 0
    for g in range(12):
        base = prose(g, 40 + 60 * g)
        docs.append((k, base))
        for c in range(g + 1):
            docs.append((k + 1 + c, edited(base, 100 * g + c, c % 5 * (g // 4 + 1))))
        k += 50
    return docs + [(900 + i, prose(1000 + i, 70)) for i in range(40)] + EDGES + [(800, "a b"), (801, "A, b!"), (None, "a b")]


@pytest.mark.parametrize("limits", [{}, {"NODE_SETS": 4, "BLOCK_SETS": 3}])
def test_links_and_classes_match_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus()
    rows = jaccard.classes(frame(spark, docs).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in rows), key=repr) == brute(docs)
    kept = defaultdict(int)
    for r in rows:
        kept[r.class_id if r.n_shingles else (r.doc_id, "alone")] += r.kept
    assert all(n == 1 or c in (None, (91, "alone")) for c, n in kept.items()), kept


def test_empty_tables(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0
    assert [r.n_links for r in jaccard.classes(frame(spark, [(1, None)])).collect()] == [0]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(40)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    up = {}
    def root(i):  # noqa: E306
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i
    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_prefixes_are_shortened_until_the_target(spark):
    links = spark.createDataFrame([(2, 1, 0.8)] * 5 + [(4, 3, 1.0)] * 5, "a long, b long, near double")
    seen = [jaccard.estimated_recall(links, d) for d in (8, 7, 6)]
    assert seen == sorted(seen) and 0.99 < seen[0] < seen[-1] <= 1
