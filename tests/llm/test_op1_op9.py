from __future__ import annotations


import math
import re
from collections import Counter

from runledger.llm import decontaminate, quality

from .helpers import EDGES, contract_words, frame, prose


def brute_hits(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = contract_words(text), set(), set()
        for item, t in items:
            v = contract_words(t)
            for k in range(max(len(v) - 10, 0) + 1 if v else 0):
                win = v[k:k + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s:s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_contamination_matches_brute_force(spark, monkeypatch):
    items = [(i, prose(i, n)) for i, n in ((1, 25), (2, 12), (3, 10), (10, 4), (11, 1))] + [(12, None), (13, ""), (1, prose(1, 25)), (14, "same text same text")]
    docs = [(k, prose(100 + k, 60)) for k in range(10)] + EDGES
    docs += [(50, prose(100, 9) + " " + prose(1, 25).upper() + " " + prose(2, 12) + "! " + prose(10, 4)), (51, prose(2, 11)), (52, prose(1, 25)[30:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, dict.fromkeys(items))
    for pairs in (32_768, 7):  # one block, several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_PAIRS", pairs)
        got = decontaminate.contamination(frame(spark, docs).repartition(3), bench).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=repr) == want
    assert any(n for _, _, n, _ in want)


def test_contamination_of_empty_tables(spark):
    docs, none = frame(spark, [(1, "a b c")]), frame(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert [r.contaminated for r in decontaminate.contamination(docs, bench).collect()] == [False]


def test_proximity(spark):
    docs = [(1, "red fox a b c d blue hen"), (2, "red x x blue"), (3, "blue red"), (4, "red"), (5, "blue")]
    index = decontaminate.build_index(frame(spark, docs).coalesce(1))
    got = {(r.doc_id, r.position) for r in decontaminate.proximity_hits(index, ["Red", "blue"], 3).collect()}
    assert {d for d, _ in got} == {2, 3}


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + d for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_quality_counts(spark):
    docs = [(k, prose(k, 80)) for k in range(6)] + EDGES + [(60, "a b c a b c a b c d\n a b\n\n a b\nq #$ é|"), (61, "a a a a a"), (62, "a b c"), (63, "\x0b\x0cü\x1c b")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(90, None, 0), (91, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark, docs), labels).collect()
    rows = lambda rs: sorted(rs, key=repr)
    assert rows((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == rows((d, *brute_counts(t)) for d, t in docs)
    for r in got:  # too few labels: only the base rule rejects
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed)
    assert quality.judge(frame(spark, []), labels.limit(0)).count() == 0


def test_binomial_tail(spark):
    cases = [(10, 0), (10, 3), (10, 10), (2000, 5), (100_000, 900), (100_000, 0), (3_000_000, 100)]
    df = spark.createDataFrame(cases, "n long, k long")
    got = [r[0] for r in df.select(quality.binomial_tail(df.n, df.k, 0.01)).collect()]
    for (n, k), p in zip(cases, got, strict=True):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(.01) + (n - j) * math.log(.99)) for j in range(k + 1))
        assert abs(p - min(want, 1)) <= 1e-6 * max(want, 1e-300) + 1e-12


def test_cutoffs_bound_false_rejections(spark):
    n = 4000
    docs = [(k, prose(k, 60) + (" # #" if k % 500 == 0 else "")) for k in range(n)] + [(n + k, prose(k, 60) + " #$%" * 40) for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(n)] + [(n + k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert sum(not got[k].kept for k in range(n)) <= 0.01 * n * len(quality.MEASURES)
    assert not any(got[n + k].kept for k in range(20))



def test_words_of_long_texts_take_bounded_memory(monkeypatch):
    import tracemalloc

    import numpy as np

    from runledger.llm import common

    rnd = np.random.default_rng(3)
    data = np.where(rnd.random(1 << 21) < 0.2, 32, rnd.integers(97, 123, 1 << 21)).astype(np.uint8)
    offsets = np.array([0, 5, 5, 1 << 20, 1 << 21], np.int64)
    tracemalloc.start()
    prints, counts = common.words(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert list(counts) == [len(bytes(data[a:b]).split()) for a, b in zip(offsets, offsets[1:])]
    for limit in (1, 7, 1000, 5000):  # the same wherever texts and words are cut
        monkeypatch.setattr(common, "WORD_BYTES", limit)
        again = common.words(data[:9000], np.array([0, 5, 5, 4000, 9000]))
        monkeypatch.setattr(common, "WORD_BYTES", 1 << 30)
        whole = common.words(data[:9000], np.array([0, 5, 5, 4000, 9000]))
        assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()


def test_index_is_stored_in_small_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(decontaminate, "slices", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))  # a segment for each text
    index = decontaminate.build_index(frame(spark, [(i, prose(i, 5)) for i in range(40)]).coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    sizes = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(sizes) == 40 and max(sizes) <= decontaminate.GROUP_SEGMENTS
