"""Repair of conversations whose turns do not alternate: align the turns to the grammar ``(s?(ua)+)?`` at least cost.

A row may be kept (cost 0), rerolled to user or assistant (1) or deleted (2), and an empty user or assistant turn may be inserted
anywhere (5).  Blank and duplicate rows must go; a truncated row that stays costs 5 more.  Of the cheapest edits the
audit is the least by ASCII, with D, I, K and R for the four.

Method: Wagner-Fischer alignment of the turns to each feasible length of the alternating string.  The target strings
that end alike share their suffixes, so one table serves all of their lengths.  Only the cells within
an Ukkonen band are filled: with an incumbent of cost C no path leaves its diagonal by more than C // 2
deletions or C // 5 insertions.  Every length that reaches the least cost is backtraced, and the audits are compared.

What is left of the target after some turns only depends on the phase: nothing placed yet, a system turn placed,
an assistant turn due, or a user turn due.  So a conversation is aligned block by block: a block gets the cost
to go from each phase at its end, and gives that at its start.  Equally cheap audits of the same rows that end in
a row are never prefixes of one another, so the least audit of a conversation is made of the least of its blocks.

Spark deals the rows by ranges of (conversation, turn, role, text fingerprint), so a conversation of any size is dealt to
many tasks.  Conversations that lie inside one partition are repaired there.  The others are repaired by fragments, one for
each partition: their duplicates are found by first occurrences, a fragment gives a 4 x 4 cost matrix, the
matrices of a conversation are chained (one small row for each partition it lies in), and each fragment is backtraced with its cost to go.
The digest of a conversation reads its blocks in order, one at a time, because a hash has to.

Rows are taken by turn (nulls first), then role, then a fingerprint of the text.  A role or text that is null
counts as one blank; only a role's first character matters for the grammar, and an empty role never fits it.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows aligned at a time, and bytes of text that a block holds besides its last row.
BLOCK_ROWS, BLOCK_BYTES = 64, 1 << 20
#: Bytes of one conversation held for its end inside a partition; a larger one is repaired by fragments.
HELD_BYTES = 32 << 20

INF = 1 << 60
START, SYSTEM, REPLY, NEXT = range(4)
#: Cost to go at the end of a conversation: insertions that complete the last pair.
ENDED = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\v\f\r"


# --- alignment ------------------------------------------------------------------------
# A row is a letter: u, a, s or o for its role's first character, upper case if truncated, x if it must go.

def _cost(code: str, letter: str) -> int:
    return (KEEP if code.lower() == letter else REROLE) + (TRUNCATED if code.isupper() else 0)


class _Table:
    """cost[i][r]: rows from i on against the last r characters of the alternating string that ends in ``last``."""

    def __init__(self, codes: str, last: str, fewer: int, more: int):
        n, self.codes, self.more = len(codes), codes, more
        self.letters = [""] + [last if r % 2 else "ua"[last == "u"] for r in range(1, n + more + 2)]
        width = n + more + 1
        self.cost = [[INF] * (width + 1) for _ in range(n + 1)]
        self.cost[n][0] = 0
        for i in range(n - 1, -1, -1):
            row, below, code = self.cost[i], self.cost[i + 1], codes[i]
            for r in range(max(0, n - i - fewer), min(width, n - i + more) + 1):
                best = DELETE + below[r]
                if r:
                    best = min(best, INSERT + row[r - 1])
                    if code != "x":
                        best = min(best, _cost(code, self.letters[r]) + below[r - 1])
                row[r] = min(best, INF)

    def trace(self, i: int, r: int) -> str:
        """The least audit among the cheapest."""
        out, n = [], len(self.codes)
        while i < n:
            want = self.cost[i][r]
            if DELETE + self.cost[i + 1][r] == want:
                out.append("D")
                i += 1
            elif r and INSERT + self.cost[i][r - 1] == want:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.codes[i].lower() == self.letters[r] else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def with_system(self, r: int) -> list[int]:
        """cost[i]: rows from i on against a system turn and then the last r characters; only a kept row can be the system turn."""
        n = len(self.codes)
        out = [INF] * (n + 1)
        for i in range(n - 1, -1, -1):
            kept = (TRUNCATED if self.codes[i] == "S" else 0) + self.cost[i + 1][r] if self.codes[i] in "sS" else INF
            out[i] = min(DELETE + out[i + 1], kept, INF)
        return out

    def trace_system(self, r: int) -> str:
        costs, i, out = self.with_system(r), 0, ""
        while DELETE + costs[i + 1] == costs[i]:
            out, i = out + "D", i + 1
        return out + "K" + self.trace(i + 1, r)


def _incumbent(codes: str, phase: int, tails: tuple[int, ...]) -> int:
    """Cost of the best of some plain alignments: all rows deleted, or all usable ones kept or rerolled straight, each with insertions to end in either phase."""
    n = len(codes)
    gone = DELETE * n
    to_reply, to_next = (INSERT, 2 * INSERT) if phase in (START, SYSTEM) else (INSERT, 0) if phase == NEXT else (0, INSERT)
    found = [gone + tails[phase], gone + to_reply + tails[REPLY], gone + to_next + tails[NEXT]]
    at, cost = phase, 0
    for code in codes:
        if code == "x":
            cost += DELETE
        elif at == START and code in "sS":
            at, cost = SYSTEM, cost + (TRUNCATED if code == "S" else 0)
        else:
            cost += _cost(code, "a" if at == REPLY else "u")
            at = NEXT if at == REPLY else REPLY
    found.append(cost + tails[at])
    if at in (REPLY, NEXT):
        found.append(cost + INSERT + 1 + tails[REPLY + NEXT - at])
    if phase == START:
        systems = [TRUNCATED if c == "S" else 0 for c in codes if c in "sS"]
        if systems:
            found.append(gone - DELETE + min(systems) + tails[SYSTEM])
    return min(found)


@lru_cache(1 << 16)
def solve(codes: str, phase: int, tails: tuple[int, int, int, int]) -> tuple[int, str, int]:
    """(cost, audit, phase after) of the cheapest alignment of a block's rows that starts in ``phase``, with the cost to go from each phase after it.

    Nothing is inserted behind the last row: such a turn belongs to what follows.
    """
    if not codes:
        return tails[phase], "", phase
    n, inc = len(codes), min(_incumbent(codes, phase, tails), INF)
    best: list[tuple[int, str, int]] = []

    def offer(cost: int, audit, end: int) -> None:
        if cost < INF and cost <= inc and (not best or cost <= best[0][0]):
            entry = (cost, audit(), end)
            if not best or entry < best[0]:
                best[:] = [entry]

    offer(DELETE * n + tails[phase], lambda: "D" * n, phase)
    for end, last in ((REPLY, "u"), (NEXT, "a")):
        budget = inc - tails[end]
        if budget < 0:
            continue
        table = _Table(codes, last, budget // DELETE, budget // INSERT)
        odd = (end == REPLY) != (phase == REPLY)  # an odd number of turns changes who is due
        lengths = range(1 if odd else 2, len(table.letters) - 1, 2)
        for r in lengths:
            offer(table.cost[0][r] + tails[end], lambda r=r: table.trace(0, r), end)
        if phase == START:
            for r in lengths:
                offer(table.with_system(r)[0] + tails[end], lambda r=r: table.trace_system(r), end)
    if phase == START and tails[SYSTEM] < INF:
        table = _Table(codes, "u", n, 0)
        offer(table.with_system(0)[0] + tails[SYSTEM], lambda: table.trace_system(0), SYSTEM)
    return best[0] if best else (INF, "", phase)


def _solve(codes: str, phase: int, tails: tuple[int, ...]) -> tuple[int, str, int]:
    """``solve`` with the least cost to go taken out, so that equal blocks are solved once."""
    least = min(tails)
    cost, audit, end = solve(codes, phase, tuple(INF if t >= INF else t - least for t in tails))
    return min(cost + least, INF), audit, end


def backward(blocks: list[str], tails: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost to go before each block, and ``tails`` behind the last."""
    out = [tails]
    for codes in reversed(blocks):
        out.append(tuple(_solve(codes, p, out[-1])[0] for p in range(4)))
    return out[::-1]


def forward(blocks: list[str], togo: list[tuple[int, ...]], phase: int) -> tuple[list[tuple[int, str]], int]:
    """((phase, audit) of each block, phase after the last)."""
    out = []
    for codes, tails in zip(blocks, togo[1:]):
        _, audit, end = _solve(codes, phase, tails)
        out.append((phase, audit))
        phase = end
    return out, phase


def closing(phase: int) -> str:
    return "I" * (ENDED[phase] // INSERT)


def edited(audit: str, rows: list[tuple[str, str]], phase: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns after the edits; deleted rows keep theirs."""
    row = iter(rows)
    for edit in audit:
        role, text = next(row) if edit != "I" else ("", "")
        if edit == "K" and phase == START and role[:1] == "s":
            phase = SYSTEM
        elif edit != "D":
            due, phase = ("assistant", NEXT) if phase == REPLY else ("user", REPLY)
            role = role if edit == "K" else due
        yield edit, role, text


# --- rows and reports -------------------------------------------------------------------

def code_of(role: str, text: str) -> str:
    """b for a blank row, else the letter of its role, upper case if truncated."""
    said = text.rstrip(SPACE)
    if not said:
        return "b"
    letter = role[:1] if role[:1] in ("u", "a", "s") else "o"
    return letter if said[-1] in ".!?" else letter.upper()


def print_of(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def usable(codes: str) -> str:
    return codes.translate({ord("b"): "x", ord("d"): "x"})


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


class Report:
    """The contract's row of one conversation, from its blocks in order."""

    def __init__(self):
        self.first = self.last = self.before = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audits, self.digest, self.some, self.phase = [], hashlib.sha256(), False, START

    def add(self, turns: list, roles: list[str], texts: list[str], codes: str, audit: str) -> None:
        for turn, role, code in zip(turns, roles, codes):
            if turn is not None and turn != self.last:
                self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            self.blank += code == "b"
            self.duplicate += code == "d"
            self.truncated += code.isupper()
        row = iter(codes)
        for edit in audit:
            code = next(row) if edit != "I" else ""
            self.cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit] + (TRUNCATED if edit in "KR" and code.isupper() else 0)
        self._put(audit, list(zip(roles, texts)))

    def _put(self, audit: str, rows: list[tuple[str, str]]) -> None:
        for edit, role, text in edited(audit, rows, self.phase):
            if edit != "D":
                self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
                self.some = True
                self.phase = SYSTEM if self.phase == START and role[:1] == "s" else NEXT if self.phase == REPLY else REPLY
        self.audits.append(audit)

    def finish(self) -> tuple:
        end = closing(self.phase)
        self.cost += INSERT * len(end)
        self._put(end, [])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audits), self.digest.hexdigest()


class _Fragment:
    """Rows of one conversation in one partition, in blocks."""

    def __init__(self, conv_id, frag: int):
        self.conv_id, self.frag, self.seen, self.flushed, self.bytes = conv_id, frag, set(), 0, 0
        self.blocks: list[list] = []
        self.room = 0

    def add(self, turn, role: str, text: str) -> None:
        if not self.blocks or self.room <= 0 or len(self.blocks[-1][0]) >= BLOCK_ROWS:
            self.blocks.append([[], [], [], [], []])
            self.room = BLOCK_BYTES
        code, mark = code_of(role, text), None
        if code != "b":
            mark = print_of(role, text)
            if mark in self.seen:
                code, mark = "d", None
            else:
                self.seen.add(mark)
        for cell, value in zip(self.blocks[-1], (turn, role, text, code, mark)):
            cell.append(value)
        self.room -= len(text)
        self.bytes += len(text) + 100

    def rows(self, whole: bool) -> list[tuple]:
        """Rows of the block table; a whole conversation gets its audit and, on its last block, its report."""
        codes = ["".join(b[3]) for b in self.blocks]
        audits, report = [(None, None)] * len(codes), None
        if whole:
            clean = [usable(c) for c in codes]
            audits, phase = forward(clean, backward(clean, ENDED), START)
            made = Report()
            for b, c, (_, audit) in zip(self.blocks, codes, audits):
                made.add(*b[:3], c, audit)
            report = made.finish()
            if audits:
                audits[-1] = (audits[-1][0], audits[-1][1] + closing(phase))
        out = [(self.conv_id, self.frag, self.flushed + k, not whole, b[0], b[1], b[2], c, None if whole else b[4], p, a, None)
               for k, (b, c, (p, a)) in enumerate(zip(self.blocks, codes, audits))]
        if whole and not out:  # every row of the conversation was dropped
            out = [(self.conv_id, self.frag, 0, False, [], [], [], "", None, START, "", None)]
        if whole:
            out[-1] = (*out[-1][:-1], dict(zip([*COUNTS, "audit", "repaired_sha256"], report)))
        if not whole and not out and not self.flushed:
            out = [(self.conv_id, self.frag, 0, True, [], [], [], "", [], None, None, None)]
        self.flushed += len(self.blocks)
        self.blocks, self.bytes = [], 0
        return out


_BLOCK = pa.schema([("conv_id", pa.int64()), ("frag", pa.int64()), ("blk", pa.int64()), ("open", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                    ("texts", pa.list_(pa.string())), ("codes", pa.string()), ("prints", pa.list_(pa.binary())), ("phase", pa.int32()), ("audit", pa.string()),
                    ("report", pa.struct([*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]))])
_BLOCK_DDL = ("conv_id long, frag long, blk long, open boolean, turns array<long>, roles array<string>, texts array<string>, codes string, prints array<binary>, "
              f"phase int, audit string, report struct<{REPORT.replace(' long', ':long').replace(' string', ':string')}>")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, out, size, now, number = TaskContext.get().partitionId(), [], 0, None, 0
    for batch in batches:
        for conv_id, turn, role, text, dropped in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")]):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    # the first of a partition may have begun in an earlier one
                    out += now.rows(whole=number > 1 and not now.flushed)
                number += 1
                now = _Fragment(conv_id, (part << 32) | number)
            if not dropped:
                now.add(turn, role, text)
                size += len(text) + 200
                if now.bytes > HELD_BYTES:
                    out += now.rows(whole=False)
            if size > BLOCK_BYTES and out:
                yield _packed(out)
                out, size = [], 0
    if now is not None:
        out += now.rows(whole=False)
    if out:
        yield _packed(out)


# --- conversations that lie in several partitions ------------------------------------------

def _late(blocks: DataFrame) -> DataFrame:
    """(frag, blk, late): places of rows whose role and text were seen in an earlier fragment of the conversation."""
    marks = blocks.select("conv_id", "frag", "blk", F.posexplode("prints").alias("at", "mark")).where("mark IS NOT NULL")
    home = marks.groupBy("conv_id", "mark").agg(F.min("frag").alias("home"), F.max("frag").alias("other")).where("home < other").select(
        F.col("conv_id").alias("own"), F.col("mark").alias("same"), "home")
    again = marks.join(home, (F.col("mark") == F.col("same")) & F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("frag") > F.col("home")))
    return again.groupBy("frag", "blk").agg(F.collect_list("at").alias("late"))  # at most BLOCK_ROWS places


def _ordered(group: pa.Table) -> tuple[list[dict], list[str]]:
    rows = sorted(group.to_pylist(), key=lambda r: r["blk"])
    return rows, [usable(r["codes"]) for r in rows]


def _matrix(group: pa.Table) -> pa.Table:
    rows, codes = _ordered(group)
    columns = [backward(codes, tuple(0 if p == q else INF for p in range(4)))[0] for q in range(4)]
    return pa.table({"conv_id": group.column("conv_id").slice(0, 1), "frag": group.column("frag").slice(0, 1), "matrix": pa.array([[columns[q][p] for p in range(4) for q in range(4)]], pa.list_(pa.int64()))})


def _chain(group: pa.Table) -> pa.Table:
    """Cost to go behind each fragment of a conversation."""
    rows, togo, out = sorted(group.to_pylist(), key=lambda r: r["frag"]), ENDED, []
    for r in reversed(rows):
        out.append(togo)
        togo = tuple(min(INF, *[r["matrix"][4 * p + q] + togo[q] for q in range(4)]) for p in range(4))
    return pa.table({"frag": pa.array([r["frag"] for r in reversed(rows)], pa.int64()), "togo": pa.array([list(t) for t in out], pa.list_(pa.int64()))})


def _traced(group: pa.Table) -> pa.Table:
    """The audits of a fragment's blocks for each phase it may start in, and the phase it then ends in."""
    rows, codes = _ordered(group)
    togo = backward(codes, tuple(rows[0]["togo"]))
    found = [forward(codes, togo, p) for p in range(4)]
    return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "frag": pa.array([r["frag"] for r in rows], pa.int64()), "blk": pa.array([r["blk"] for r in rows], pa.int64()),
                     "codes": pa.array([r["codes"] for r in rows]), "ends": pa.array([[end for _, end in found]] * len(rows), pa.list_(pa.int32())),
                     "phases": pa.array([[f[0][k][0] for f in found] for k in range(len(rows))], pa.list_(pa.int32())),
                     "audits": pa.array([[f[0][k][1] for f in found] for k in range(len(rows))], pa.list_(pa.string()))})


def _starts(group: pa.Table) -> pa.Table:
    """The phase each fragment of a conversation starts in, and what closes its last."""
    rows, phase, out = sorted(group.to_pylist(), key=lambda r: r["frag"]), START, []
    for r in rows:
        out.append(phase)
        phase = r["ends"][phase]
    ends = [""] * (len(rows) - 1) + [closing(phase)]
    return pa.table({"frag": pa.array([r["frag"] for r in rows], pa.int64()), "begins": pa.array(out, pa.int32()), "closing": pa.array(ends)})


def _repaired_fragments(blocks: DataFrame) -> DataFrame:
    """(frag, blk, codes, phase, audit) of the open blocks; only codes travel, not texts."""
    late = _late(blocks)
    codes = blocks.select("conv_id", "frag", "blk", "codes").join(late, ["frag", "blk"], "left")
    mended = F.transform(F.split("codes", ""), lambda c, i: F.when(F.array_contains("late", i), "d").otherwise(c))
    codes = cut(codes.select("conv_id", "frag", "blk", F.array_join(mended, "").alias("codes")), "turn-codes")
    matrices = codes.groupBy("frag").applyInArrow(_matrix, "conv_id long, frag long, matrix array<long>")
    togo = matrices.groupBy("conv_id").applyInArrow(_chain, "frag long, togo array<long>")
    traced = cut(codes.join(togo, "frag").groupBy("frag").applyInArrow(
        _traced, "conv_id long, frag long, blk long, codes string, ends array<int>, phases array<int>, audits array<string>"), "turn-audits")
    starts = traced.where("blk = 0").select("conv_id", "frag", "ends").groupBy("conv_id").applyInArrow(_starts, "frag long, begins int, closing string")
    last = traced.groupBy("frag").agg(F.max("blk").alias("last"))
    chosen = traced.join(starts.join(last, "frag"), "frag")
    at = F.col("begins") + 1
    return chosen.select("frag", "blk", "codes", F.element_at("phases", at).alias("phase"),
                         F.concat(F.element_at("audits", at), F.when(F.col("blk") == F.col("last"), F.col("closing")).otherwise("")).alias("audit"))


# --- the operator --------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows with the faults that ``crc32(conv_id:turn) % 20`` picks; a dropped row stays as a mark of its conversation."""
    blank = F.lit(" ")
    def known(c): return F.coalesce(F.col(c).cast("string"), blank)  # noqa: E704
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fault.alias("fault"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"))


def repair(rows: DataFrame) -> DataFrame:
    """Blocks of the conversations with their audits, written once: (conv_id, frag, blk, turns, roles, texts, codes, phase, audit, open, report).

    ``rows`` holds conv_id, turn, role, text and, optionally, ``dropped`` (the row only says that its conversation exists).  A block
    is a run of rows of one conversation, blocks are ordered by (frag, blk).  Blocks of a conversation that lay in one partition are not ``open``, and its last has its ``report``.
    """
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    def known(c): return F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E704
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), dropped.alias("dropped"))
    # equal rows are told apart by a number, so that many of them need not lie in one partition
    own = own.withColumn("same", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", "same", "nth"]
    dealt = own.repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "role", "same", "text", "nth")
    blocks = cut(dealt.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(_fragments, _BLOCK_DDL), "turn-blocks")
    done = blocks.where("NOT open").drop("prints")
    left = blocks.where("open")
    audits = _repaired_fragments(left)
    rest = left.drop("prints", "codes", "phase", "audit").join(audits, ["frag", "blk"])
    return done.unionByName(rest.select(*done.columns))


def turns(blocks: DataFrame) -> DataFrame:
    """(conv_id, frag, blk, pos, edit, role, text): the turns after repair in order; deleted rows have edit D."""
    made = F.udf(lambda audit, roles, texts, phase: list(edited(audit, list(zip(roles, texts)), phase)), "array<struct<edit:string,role:string,text:string>>", useArrow=True)
    return blocks.select("conv_id", "frag", "blk", F.posexplode(made("audit", "roles", "texts", "phase")).alias("pos", "row")).select("conv_id", "frag", "blk", "pos", "row.*")


def reports(blocks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    done = blocks.where("report IS NOT NULL").select("conv_id", "report.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if made is None or r["conv_id"] != now:
                    if made is not None:
                        out.append((now, *made.finish()))
                    now, made = r["conv_id"], Report()
                # a block ends with a row; insertions behind it close the conversation, and finish adds those
                made.add(r["turns"], r["roles"], r["texts"], r["codes"], r["audit"].rstrip("I"))
        if made is not None:
            out.append((now, *made.finish()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k != 0 else pa.array(list(c), pa.int64()) for k, c in enumerate(zip(*out))],
                                             ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    ordered = blocks.where("open").select("conv_id", "frag", "blk", "turns", "roles", "texts", "codes", "audit").repartition("conv_id").sortWithinPartitions("conv_id", "frag", "blk")
    return done.unionByName(ordered.mapInArrow(run, f"conv_id long, {REPORT}"))
