"""Cross-tokenizer alignment against loops over all pairs of tokens, and the perfect hash on its own."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runledger.llm import crosstoken, queries
from tests.llm.helpers import EDGES, frame, prose

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
EXTRA = [(1, "a  b\n\n c▁d </s> <0x41> \t x "), (2, "say <|endoftext|> twice <|endoftext|>"), (3, "▁"), (4, "日本 \U0001F600 é"),
         (5, "tail   "), (6, "\x00 nul"), (7, "long " * 30_000), (8, "▁x " * 9)]


def _bytes_a():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return letters


def brute(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp, letters = sentencepiece.SentencePieceProcessor(model_file=B), _bytes_a()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)] if text else []
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            a = b = []
        def spans(side):  # noqa: E306
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out
        sa, sb = spans(a), spans(b)
        common = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        links, k = [], 0
        for i, s, e in sa:
            while k < len(sb) and sb[k][2] <= s:
                k += 1
            j = k
            while j < len(sb) and sb[j][1] < e:
                links.append((i, sb[j][0]))
                j += 1
        def dealt(side):  # noqa: E306
            out, g = [[] for _ in common], 0
            for i, _, e in side:
                out[g].append(i)
                g += e == common[g]
            return out
        groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(dealt(sa), dealt(sb)))
        docs.append((doc_id, len(sa), len(sb), len(common), links, groups))
        counts.update(set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((d, na, nb, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), groups) for d, na, nb, g, links, groups in docs), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    return [(100 + i, prose(i, 60)) for i in range(12)] + EXTRA + EDGES


@pytest.fixture(scope="module")
def wanted(corpus):
    return brute(corpus)


def test_equals_brute_force(spark, corpus, wanted):
    assert rows_of(crosstoken.align(frame(spark, corpus).repartition(3), A, B)) == wanted


def test_many_small_blocks_shares_and_rounds_change_nothing(spark, corpus, wanted, monkeypatch):
    for name, value in (("BLOCK_PAIRS", 200), ("SHARE_ROWS", 20), ("FAN_IN", 2), ("BLOCKS_AT_ONCE", 2)):
        monkeypatch.setattr(crosstoken, name, value)
    assert rows_of(crosstoken.align(frame(spark, corpus).repartition(5), A, B)) == wanted


def test_no_documents(spark):
    assert crosstoken.align(frame(spark, []), A, B).collect() == []
    assert rows_of(crosstoken.align(frame(spark, [(1, None)]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_columns(spark, corpus, wanted, tmp_path):
    frame(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_cross_tokenizer(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    shown = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in wanted]
    assert rows_of(got) == sorted(shown, key=repr)
    assert not got.where(F.col("n_links") != F.col("n_a") + F.col("n_b") - F.col("n_groups")).count()


def test_perfect_hash_is_minimal_and_survives_writing():
    keys = np.unique(np.random.default_rng(7).integers(0, 1 << 32, 50_000))
    made = crosstoken.PerfectHash.load(crosstoken.PerfectHash.of(keys).dump())
    assert made.size == len(keys) and np.array_equal(np.sort(made.number(keys)), np.arange(len(keys)))
    assert crosstoken.PerfectHash.of(np.zeros(0, np.int64)).number(keys[:3]).tolist() == [-1, -1, -1]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    side = crosstoken._piece_side(B)
    texts = ["ab cd  ef▁ gh " * 40, "x" * 300, " " * 300, ("word " * 20 + "  ") * 5]
    plain = [side.model.encode(t) for t in texts]
    monkeypatch.setattr(crosstoken, "PIECE_CHARS", 50)
    assert side.cuts and [x.tolist() for x in side.ids(texts)] == plain
