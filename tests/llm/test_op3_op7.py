from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runledger.llm import packing, tokenfiles, tokens
from runledger.llm.tokens import Encoder

from .helpers import EDGES, frame, prose

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_tokenizer(path, monkeypatch):
    monkeypatch.setattr("runledger.llm.tokens.KEPT_PIECES", 500)
    rnd, enc = random.Random(5), Encoder(path)
    texts = ["".join(rnd.choice("aàAÉßÿ÷×İΣς 1２'’s.,\n\t   <|>endoftext中🙂é-\x1c\u0301") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [prose(k, 80) for k in range(20)] + ["<|endoftext|> a", "x<|endoftext|>", "a  b   c\n\n d \n", " ", "\n", "", "It's we'LL. don't'S"]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts * 2, want * 2, strict=True):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == ids, t


def plain_ids(path, text):
    tok = Tokenizer.from_file(path)
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 2_000)
    docs = [(k * 3 % 101, prose(k, 60)) for k in range(40)] + EDGES + [(201, "a <|endoftext|> b"), (202, "<|endoftext|><|startoftext|>")]
    manifest = tokenfiles.write(frame(spark, docs).repartition(4), BYTE, length=32, rows=4)
    got = tokenfiles.read_documents(manifest).collect()
    assert manifest.count() > 1
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([d for d, _ in docs], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = [(d, len(ids), crc(ids)) for d, t in docs for ids in [plain_ids(BYTE, t) + [0]]]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    one = manifest.orderBy(F.desc("n_tokens")).first()
    file = tokenfiles.TokenFile(one.path, one.docs_path)
    whole = np.concatenate([ids[mask] for ids, mask in (file.sequence(k) for k in range(-(-one.n_tokens // 32)))])
    assert whole.tolist() == np.concatenate([*file.tokens(0, one.n_tokens)]).tolist() and len(whole) == one.n_tokens
    ids, _ = file.sequence(1)
    assert not ids.flags.owndata and ids.dtype == np.uint16  # a view of the mapped file


def test_token_files_of_no_documents(spark):
    assert tokenfiles.read_documents(tokenfiles.write(frame(spark, []), BYTE)).count() == 0


def check_packing(rows, docs, capacity):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for d, t in docs:
        ids = plain_ids(WORD, t) + [1]
        want += [(d, k, k * capacity, len(p), crc(p)) for k in range(-(-len(ids) // capacity)) for p in [ids[k * capacity:(k + 1) * capacity]]]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)

    return len(by_seq)


@pytest.mark.parametrize("shard", [50_000, 20])
def test_packing(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    docs = [(k, prose(k, 5 + k * 7 % 90)) for k in range(60)] + EDGES
    rows = packing.pack(frame(spark, docs).repartition(3), WORD, capacity=256, with_ids=True).collect()
    n = check_packing(rows, docs, 256)
    least = -(-sum(r.length for r in rows) // 256)
    assert n <= least + (1 if shard > 1000 else 4)
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in rows)


def test_packing_of_no_documents(spark):
    assert packing.pack(frame(spark, []), WORD).count() == 0


def test_local_search_beats_best_fit():
    better = 0
    for seed in range(200):
        rnd = random.Random(seed)
        lengths = np.asarray([rnd.randint(20, 60) for _ in range(40)])
        before, after = packing.best_fit(lengths, 100), packing.pack_lengths(lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(40)) and all(sum(lengths[b]) <= 100 for b in after)
        assert len(after) <= len(before)
        better += len(after) < len(before)
    assert better


def test_bins_of_many_pieces_take_part_in_pair_moves():
    """More than 64 pieces in a bin: two of them must still be exchanged for one, in either direction."""
    lengths = np.asarray([1, 2] * 60 + [157, 3])
    big, small = [*range(120)], [120, 121]
    search = packing._Search([big, small], lengths, 182)
    assert search._sums(0) == {2, 3, 4} and search._pick(0, 3, 2) and len(search._pick(0, 4, 2)) == 2 and search._pick(0, 9, 2) == ()
    assert len(search._index() and np.flatnonzero(search.room[2][0] >= 0)) >= 3


def test_local_search_stops_at_no_improving_move():
    """After the search no exchange of one for one, one for two, two for one or one for none raises the sum of squares."""
    for seed in range(40):
        rnd = random.Random(seed)
        lengths = np.asarray([rnd.choice([1, 2, 3, 40, 55, 61]) for _ in range(rnd.choice([30, 150]))])
        search = packing._Search(packing.best_fit(lengths, 100), lengths, 100)
        search.run()
        fills = sorted(f for f in search.fill if f)
        if len(fills) == search.least:
            continue
        for b, mine in enumerate(search.bins):
            ones = {int(lengths[i]) for i in mine}
            gives = ones | search._sums(b)
            for o, own in enumerate(search.bins):
                room = 100 - search.fill[o]
                if o == b or not mine or not own or search.fill[b] > search.fill[o]:
                    continue
                theirs = {int(lengths[i]) for i in own}
                assert not any(x <= room for x in ones)
                assert not any(0 < x - y <= room for x in gives for y in theirs)
                assert not any(0 < x - y <= room for x in ones for y in search._sums(o))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_signs_and_line_feeds_around_new_words_need_one_call(name, monkeypatch):
    enc, calls = Encoder(public_tokenizers.path(name)), []
    whole = enc.whole
    monkeypatch.setattr(enc, "whole", lambda text: (calls.append(text), whole(text))[1])
    words = [a + b + c for a in "ABéß" for b in "xyÖq" for c in "mnop"]
    texts = [f"{w} {w[::-1]}&&& {w}z!!\n{w}k. {w}" for w in words]
    got = [enc.ids(t) for t in texts]
    assert len(calls) <= 4
    assert got == [whole(t) for t in texts]
    for odd in ["it's_ok", " don't''", "a_b_", "x<s>", "\n\nword!!", "é1&", "!!", "a<b|c>"]:
        assert enc.ids(odd) == whole(odd)


def test_only_new_pieces_are_looked_through(monkeypatch):
    seen, look = [], tokens._OTHER_SPACE
    monkeypatch.setattr(tokens, "_OTHER_SPACE", lambda piece: seen.append(piece) or look(piece))
    enc = tokens.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = "one two\nthree one  two, <|endoftext|> and\tmore"
    plain = text.split(" <|")[0]
    for t in (plain, plain, text, "two\tone", text, plain):
        assert enc.ids(t) == enc.whole(t)
    assert seen[:5] == ["one", " two", "\nthree", " one", "  two,"] and seen[5:] == [" <|endoftext|>", "two\tone", " <|endoftext|>"]
