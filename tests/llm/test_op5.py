from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest

from runledger.llm import suffixdedup
from runledger.llm.suffixdedup import Sizes

from .helpers import frame, prose


def brute(docs, width):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[p:p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(docs, texts, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if seen[t[p:p + width]] > 1:
                gone[p:p + width] = [True] * width
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def corpus(width):
    rnd = random.Random(width)
    shared = [prose(k, 3 * width)[:rnd.randint(width - 3, 3 * width)] for k in range(8)]
    docs = []
    for d in range(60):
        bits = [prose(1000 + d, rnd.randint(1, width // 4)) for _ in range(2)]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.choice([0, 0, rnd.randrange(len(s))])
            bits.insert(rnd.randrange(len(bits) + 1), s[a:a + rnd.choice([len(s), width, width - 1, width + 1])])
        docs.append((d, rnd.choice(["", " ", "é"]).join(bits)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "a" * (3 * width)), (103, "ab" * width), (104, "x" * width), (105, "y" * (width + 1)), (106, None), (107, ""), (None, docs[5][1]), (108, "z" * (width - 1))]
    return docs + [docs[7], docs[7]]


@pytest.mark.parametrize(("z", "crowd"), [(Sizes(40, 8, 8), 20_000), (Sizes(40, 8, 8), 2), (Sizes(400, 32, 62), 20_000), (Sizes(33, 8, 26), 5)])
def test_matches_brute_force(spark, monkeypatch, z, crowd):
    monkeypatch.setattr(suffixdedup, "CORE_TUPLES", crowd)
    docs = corpus(z.width)
    rows = suffixdedup.deduplicate(frame(spark, docs).repartition(3), z).collect()
    got = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows), key=repr)
    want = brute(docs, z.width)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert got == want and any(w[2] for w in want)


def test_empty_tables(spark):
    assert suffixdedup.deduplicate(frame(spark, [])).count() == 0
    assert [len(r.spans) for r in suffixdedup.deduplicate(frame(spark, [(1, None), (2, "short")])).collect()] == [0, 0]


def test_strings_of_a_crowded_core_are_named_by_slices():
    n, z = 2 * suffixdedup.NAMED + 7, Sizes()
    side = z.block - 1
    batch = pa.record_batch({"core": pa.array([1] * n), "doc_id": pa.array(range(n), pa.int64()), "print": pa.array([0] * n), "base": pa.array([5] * n, pa.int32()),
                             "lefts": pa.array([b"a" * side] * n), "rights": pa.array([b"b" * side] * n)})
    out = list(suffixdedup._named(iter([batch]), z))
    assert max(b.num_rows for b in out) <= suffixdedup.NAMED * z.block
    whole = pa.Table.from_batches(out)
    assert whole.num_rows == n * z.block and whole.column("doc_id").unique().to_pylist() == list(range(n))
    assert len(whole.column("name").unique()) == z.block and whole.column("s").unique().to_pylist() == list(range(z.block))


def test_texts_of_several_slices(spark):
    rnd = random.Random(9)
    block = "".join(rnd.choice("abcdefgh") for _ in range(700))
    docs = [(k, "".join(rnd.choice("abcdefgh") for _ in range(500_000)) + f"{k}" + (block if k in (1, 5) else "")) for k in range(6)]
    got = {r.doc_id: r for r in suffixdedup.deduplicate(frame(spark, docs).coalesce(1)).collect()}
    for k, text in docs:
        assert [(s.begin, s.end) for s in got[k].spans] == ([(500_001, 500_701)] if k in (1, 5) else [])
        assert got[k].n_bytes == len(text) and bytes(got[k].kept).decode() == text[:500_001]
