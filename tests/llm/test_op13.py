"""Structure repair against a plain automaton over the rows, which keeps the least audit of every state."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from runledger.llm import queries, structure

SCHEMA = "conv_id long, turn long, role string, text string, blk int, audit string"
MOVES = {("start", "s"): "sys", ("start", "u"): "due", ("sys", "u"): "due", ("due", "a"): "next", ("next", "u"): "due"}


def brute_audit(rows):
    """rows of (initial, must go, truncated) -> (cost, audit)."""
    states = {"start": (0, "")}

    def offer(out, state, cost, audit):
        if state not in out or (cost, audit) < out[state]:
            out[state] = (cost, audit)

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit) in list(states.items()):
                for letter in "ua":
                    if (state, letter) in MOVES:
                        offer(states, MOVES[state, letter], cost + 5, audit + "I")
        return states

    for letter, gone, cut_off in rows:
        out = {}
        for state, (cost, audit) in inserted(states).items():
            offer(out, state, cost + 2, audit + "D")
            for to in "" if gone else "uas":
                if (state, to) in MOVES and (to != "s" or letter == "s"):
                    offer(out, MOVES[state, to], cost + (letter != to) + 5 * cut_off, audit + ("K" if letter == to else "R"))
        states = out
    return min(v for s, v in inserted(states).items() if s in ("start", "next"))


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for c, t, role, text in damaged(rows):
        convs[c].append((t, role, text))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        seen, given, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            said = text.strip(" \t\n\v\f\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] = n.get(fault, 0) + 1
            given.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(given, given[1:]))
        cost, audit = brute_audit(given)
        some = [t for t, _, _ in turns if t is not None]
        gaps = max(some) - min(some) + 1 - len(set(some)) if some else 0
        shown, rest = [], iter(turns)
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            due = "assistant" if shown and shown[-1][0][:1] == "u" else "user"
            shown.append((role if edit == "K" else due, text))
        done = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in shown).encode()).hexdigest()
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, done))
    return sorted(out, key=repr)


def conversations(seed=5, many=60, longest=9):
    rnd, rows = random.Random(seed), []
    for c in [None, *range(many)]:
        for t in range(rnd.randint(1, longest)):
            role = rnd.choice(["system", "user"]) if t == 0 else ["user", "assistant"][(t + rnd.randint(0, 9) // 9) % 2]
            role = rnd.choice([role] * 12 + [None, "", "tool", "unknown"])
            text = rnd.choice([f"Words {rnd.randint(0, 99)}. ", f"No end {c}", "Same.", None, "", " \n", "日本!", "x" * 3000 + "?"])
            rows.append((c, None if rnd.random() < .03 else t * rnd.choice([1, 1, 1, 2]) * 1000 + t, role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def reported(spark, rows, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = structure.reports(structure.repair(structure.damage(frame(spark, rows).repartition(3))))
        assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return sorted((tuple(r) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_equals_brute_force(spark, parts):
    rows = conversations()
    assert reported(spark, rows, parts) == brute(rows)


def test_one_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(structure, "BLOCK_ROWS", 7)
    rows = [r for r in conversations(8, 3)] + [(1000, r[1], r[2], r[3]) for r in conversations(9, 1, 150) if r[0] is not None and r[1] is not None]
    rows += [(1000, 500_000 + k, ["user", "assistant"][k % 2], f"Turn {k % 40}.") for k in range(200)]
    assert reported(spark, rows, 16) == brute(rows)


def test_nothing_left_and_nothing_there(spark):
    gone = [(c, t, "user", "Hello.") for c in range(30) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone and reported(spark, gone, 2) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in sorted({g[0] for g in gone}, key=str)]
    assert reported(spark, [], 2) == []


def test_blocks_align_like_the_automaton():
    rnd = random.Random(1)
    for _ in range(3000):
        codes = "".join(rnd.choice("uuuaaasoUASx") for _ in range(rnd.randint(1, 9)))
        want = brute_audit([(c.lower(), c == "x", c.isupper()) for c in codes])
        cuts = sorted(rnd.sample(range(len(codes) + 1), min(rnd.randint(0, 3), len(codes))))
        blocks = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)])]
        togo = structure.backward(blocks, structure.ENDED)
        found, phase = structure.forward(blocks, togo, structure.START)
        assert (togo[0][0], "".join(a for _, a in found) + structure.closing(phase)) == want, codes


def test_repaired_turns_alternate(spark):
    rows = structure.turns(structure.repair(structure.damage(frame(spark, conversations(4, 20))))).where("edit <> 'D'").collect()
    convs = {}
    for r in sorted(rows, key=lambda r: (r["frag"], r["blk"], r["pos"])):
        convs.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert convs and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in convs.values())


def test_query(spark, tmp_path):
    rows = conversations(6, 30)
    frame(spark, rows).drop("blk", "audit").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in queries.op13_structure_repair(spark, str(tmp_path)).collect()), key=repr) == brute(rows)
