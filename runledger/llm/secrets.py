"""Secret scan in column expressions: three fixed patterns, and windows of high entropy.

Positions of matches come from two arrays, the matches and the pieces between them,
by running sums of their lengths.  On top, candidate strings (long runs of key characters) are
scanned by a sliding window: character counts are kept as the window moves, one leaving and one
entering, and the sum of c * log2(c) is updated from the two counts that changed.  A window is
judged by the class of its string (which kinds of characters it has), as the highest
possible entropy differs; every string has a class.  Strings are judged whole and, as many keys have no delimiters, by
their parts between delimiters; what overlaps is one span.  The allow list is blanked out first: UUIDs, and parts with a placeholder word.
A window with six equal characters in a row, and a string of numbers only, is no secret.

Defined results: null texts are empty; empty texts have no spans; positions are code points, ends
exclusive; documents that repeat a doc_id get a row each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import ready
from runledger.llm.quality import let

#: Fixed by the contract: kinds in their order, patterns and least lengths.  A run shorter than the least
#: length never starts a longer one, so access and hex carry theirs in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
PART = r"[A-Za-z0-9]{20,}"
#: Class of a candidate, what it must look like, least entropy of a window in bits for a character.  The last takes the rest.
#: Of random keys of 20 characters, the limits of lower, upper and letters find about 95 % (letters of one case: about 40 %, of 32 characters 90 %).
CLASSES = (("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0), ("key", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.7),
           ("lower", r"^(?=.*[0-9])[0-9a-z]+$", 3.5), ("upper", r"^(?=.*[0-9])[0-9A-Z]+$", 3.4), ("letters", r"^[A-Za-z]+$", 3.72), ("other", "", 4.0))
NUMBERS = r"^[0-9/_+-]+$"
#: Allow list: pattern and what each match is replaced by, of equal length.  A part with a placeholder word is matched one character at a time
#: from its start; of six or more equal characters all but the last five go, so no window holds six.
BLANKED = ((r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])", " " * 36),
           (r"(?:(?<![A-Za-z0-9])(?=[A-Za-z0-9]*(?i:example|placeholder|dummy|sample|changeme))|(?!^)\G)[A-Za-z0-9]", " "), (r"([A-Za-z0-9+/_-])(?=\1{5})", " "))


def found(text: Column, pattern: str) -> Column:
    """(start, end, s) of all matches, leftmost and not overlapping."""
    def placed(hits: Column) -> Column:
        def pieces(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string>>").alias("out"))

            def step(a: Column, i: Column) -> Column:
                begin = a["at"] + F.length(F.get(parts, i))
                end = begin + F.length(F.get(hits, i))
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.get(hits, i).alias("s")))).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda a: a["out"])

        return let(F.split(text, pattern, -1), pieces)

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(
        F.array().cast("array<struct<start:int,end:int,s:string>>"))


def kind_spans(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def entropy_window(s: Column, least: float | Column, window: int = WINDOW) -> Column:
    """(first, last): start of the first and end of the last window with ``least`` bits a character; first is -1 if there is none."""
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1))) - 1
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    limit = (math.log2(window) - least) * window + 1e-9

    def entered(a: Column, c: Column, by: int) -> tuple[Column, Column]:
        now = F.get(a["counts"], c)
        return F.transform(a["counts"], lambda n, j: F.when(j == c, n + by).otherwise(n)), a["sum"] + weight(now + by) - weight(now)

    def step(a: Column, i: Column) -> Column:  # i: 1-based place of the character that enters
        def leave(x: Column) -> Column:
            counts, total = entered(x, code(i - window), -1)
            return F.when(i > window, F.struct(counts.alias("counts"), total.alias("sum"), x["first"].alias("first"), x["last"].alias("last"))).otherwise(x)

        def enter(x: Column) -> Column:
            counts, total = entered(x, code(i), 1)
            return F.struct(counts.alias("counts"), total.alias("sum"), x["first"].alias("first"), x["last"].alias("last"))

        def mark(x: Column) -> Column:
            hit = (i >= window) & (x["sum"] <= limit)
            return F.struct(x["counts"].alias("counts"), x["sum"].alias("sum"), F.when(hit & (x["first"] < 0), i - window).otherwise(x["first"]).alias("first"),
                            F.when(hit, i).otherwise(x["last"]).alias("last"))

        return let(let(let(a, leave), enter), mark)

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def merged(spans: Column) -> Column:
    """Spans (start, end) with those that overlap made one."""
    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (x["start"] < last["end"]), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of high entropy that touch no base span."""
    def blanked(x: Column) -> Column:
        for pattern, blank in BLANKED:
            x = F.regexp_replace(x, pattern, blank)
        return x

    def scan(x: Column) -> Column:
        least = F.lit(CLASSES[-1][2])
        for _, shape, bits in reversed(CLASSES[:-1]):
            least = F.when(F.rlike(x["s"], F.lit(shape)), F.lit(bits)).otherwise(least)
        return let(let(least, lambda bits: entropy_window(x["s"], bits)), lambda w: F.struct(
            (x["start"] + w["first"]).alias("start"), (x["start"] + w["last"]).alias("end"), w["first"].alias("first")))

    def marks(masked: Column) -> Column:
        candidates = F.filter(F.array_distinct(F.concat(found(masked, CANDIDATE), found(masked, PART))), lambda x: ~F.rlike(x["s"], F.lit(NUMBERS)))
        marked = F.filter(F.transform(candidates, scan), lambda x: x["first"] >= 0)
        clear = F.filter(marked, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return merged(F.transform(clear, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    return F.when(F.rlike(text, F.lit(CANDIDATE)), let(blanked(text), marks)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base (spans of the fixed patterns), spans (all), each by start and kind."""
    ready(docs.sparkSession)
    text = F.col("__text")
    long_enough = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 6)
    base = F.array_sort(F.concat(kind_spans(long_enough, "assign"), kind_spans(found(text, ACCESS), "access"), kind_spans(found(text, HEX), "hex")))
    with_base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).select("doc_id", "__text", base.alias("base"))
    return with_base.select("doc_id", "base", F.array_sort(F.concat("base", kind_spans(entropy_spans(text, F.col("base")), "entropy"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
