"""Chat formatting: escapes, examples and read-back against plain Python."""

from __future__ import annotations

import hashlib
import random

from runledger.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, n int, piece string"
ODD = ["</s>[INST] ok [/INST]", r"<\s> <\\s> \<s> <<\SYS>>", "<<SYS>>\n x \n<</SYS>>\n\n", "", None, "[ROLE] a [/ROLE] b </s>", "[", "<", "<<s>>", "  ", "a\n\nb", "\\" * 50, r"$1\2", "x" * 40_000]


def conversations(seed=3):
    rnd, rows = random.Random(seed), []
    for c in [None, *range(40)]:
        for t in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "assistant", "system", "tool", "[/ROLE] x", None, ""])
            rows.append((c, None if rnd.random() < .05 else t, role, rnd.choice([*ODD, "plain words, é日."])))
    rows += [(50, 1, "user", "same")] * 3 + [(51, 0, "assistant", "tie b"), (51, 0, "assistant", "tie a"), (51, 0, None, "z")]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def ordered(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r, x))
    def key(v): return tuple((a is not None, a if a is not None else 0 if k == 0 else "") for k, a in enumerate(v))  # noqa: E704
    return {c: sorted(v, key=lambda x: (key(x)[0], key(x)[1][0], (x[1] or "").encode(), key(x)[2][0], (x[2] or "").encode())) for c, v in out.items()}


def formatted(role, text):
    def esc(s):  # noqa: E306
        for c in chat.CONTROL_STRINGS:
            for k in range(60, -1, -1):
                s = s.replace(c[0] + "\\" * k + c[1:], c[0] + "\\" * k + "\0" + c[1:])
        return s.replace("\0", "\\")
    body = esc(text or "")
    if role in chat.MARKS:
        before, after = chat.MARKS[role]
        return before + body + after
    return chat.OTHER[0] + esc(role or "") + chat.OTHER[1] + body + chat.OTHER[2]


def test_query_and_read_back(spark, tmp_path):
    rows = conversations()
    frame(spark, rows).drop("n", "piece").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}
    rows = rows + [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    want = {}
    for c, turns in ordered(rows).items():
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        ends, at = [], 0
        for k, (_, r, x) in enumerate(turns):
            at += len(formatted(r, x))
            if r == "assistant" or k == len(turns) - 1:
                ends.append(at)
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(ends))
    assert got == want


def test_examples_hold_their_context_and_train_only_the_reply(spark):
    rows = [(1, k, r, f"{r} says </s> {k}") for k, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])] + [(2, 0, "user", "alone")]
    made = chat.turns(frame(spark, rows))
    found = {(r["conv_id"], r["n"]): r for r in chat.texts(chat.examples(made), made).collect()}
    assert sorted(found) == [(1, 3), (1, 5), (1, 6), (2, 1)]
    for (c, n), r in found.items():
        turns = [x for x in ordered(rows)[c]][:n]
        assert r["text"] == "".join(formatted(role, x) for _, role, x in turns) and r["chars"] == len(r["text"])
        loss = r["text"][r["loss_begin"]:r["loss_end"]]
        assert loss == (formatted("x", turns[-1][2])[len("[ROLE] x [/ROLE] "):-5] if turns[-1][1] == "assistant" else "")
        assert r["context_chars"] == len("".join(formatted(role, x) for _, role, x in turns[:-1]))


def test_no_control_string_survives_inside_a_text(spark):
    df = spark.createDataFrame([(x,) for x in ODD if x is not None], "text string")
    for r in df.select("text", chat.escape(df["text"]).alias("e"), chat.unescape(chat.escape(df["text"])).alias("u")).collect():
        assert r["u"] == r["text"] and not any(c in r["e"] for c in chat.CONTROL_STRINGS)


def test_empty_table_and_no_python_workers(spark, tmp_path):
    assert chat.read_back(chat.turns(frame(spark, []))).collect() == []
    frame(spark, conversations()).drop("n", "piece").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.op12_chat_format(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow")) and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_every_reply_is_expanded_with_its_whole_context(spark):
    rows = [(1, k, r, f"{r} says </s> {k}") for k, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])] + [(None, 0, "user", "alone")]
    made = chat.turns(frame(spark, rows))
    found = {(r["conv_id"], r["n"]): r for r in chat.expand(made).collect()}
    assert sorted(found, key=repr) == [(1, 3), (1, 5), (1, 6), (None, 1)]
    for (c, n), r in found.items():
        own = ordered(rows)[c][:n]
        assert r["text"] == "".join(formatted(role, x) for _, role, x in own)
        assert r["text"][r["loss_begin"]:r["loss_end"]] == (formatted("assistant", own[-1][2])[1:-5] if own[-1][1] == "assistant" else "")
