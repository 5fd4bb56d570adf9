"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Each rule compares one measure of a text with a cutoff.  For every stratum (language)
and rule, the labelled documents are a holdout: a cutoff is admissible if the exact
(Clopper-Pearson) upper bound on the share of good documents it rejects stays within
``limit``.  The bound is tested as a binomial tail, P(X <= rejected | n, limit) <=
level, where the level is divided by the number of all tests (Bonferroni: cutoffs x rules
x strata), so all guarantees hold together with probability 1 - ``risk``.  Of the
admissible cutoffs, the one that rejects most is used.  A stratum with too few
labels admits none and rejects nothing.  Everything is DataFrame expressions.

Defined results: null, empty and wordless texts have zero counts and fail the base rule on the number of words; a
null language is a stratum of its own; documents that repeat a doc_id are judged one by one; repeated
labels count each; labels with a null quality are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import ready

#: Fixed by the contract.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word_chars", "few_words")
#: A rule's cutoffs to try: so many quantiles of the measure over the labelled documents of a stratum.
GRID = 20


def counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column."""
    text = F.coalesce(text, F.lit(""))
    parts = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return {"words": parts, "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def repeated_words(parts: Column) -> Column:
    """Number of words inside 3-word windows that are found twice or more.

    Windows are sorted by fingerprint with their place; those equal to a neighbour are
    repeated, and each adds the words up to the next repeated window, three at most.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(parts) - 3), lambda i: F.struct(
        F.xxhash64(F.get(parts, i), F.get(parts, i + 1), F.get(parts, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    return F.when(F.size(parts) < 4, 0).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered))).cast("long")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts and the measures of every document, with the columns to keep."""
    own = counts(F.col("__text"))
    df = docs.select(*keep, F.col("text").alias("__text")).select(*keep, *[c.alias(f"__{n}") for n, c in own.items()])
    df = df.select(*keep, F.size("__words").cast("long").alias("n_words"), *[F.col(f"__{n}").alias(n) for n in own if n != "words"],
                   let(F.col("__words"), repeated_words).alias("n_repeat_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.select("*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_words").alias("dup_line_share"),
                     share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word_chars"),
                     (-F.col("n_words")).cast("double").alias("few_words"))


def base_failed() -> Column:
    """Fixed by the contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in scaled steps so that it can't underflow.

    Terms are carried relative to the largest so far, whose logarithm is kept apart.
    """
    start = F.struct((n * F.log1p(F.lit(-p))).alias("log_term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        ratio = (n - j + 1) / j * (p / (1 - p))
        # sum is relative to the newest term
        return F.struct((a["log_term"] + F.log(ratio)).alias("log_term"), (a["sum"] / ratio + 1).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n, 1.0).otherwise(F.aggregate(steps, start, step, lambda a: F.exp(a["log_term"] + F.log(a["sum"]))))


def cutoffs(features: DataFrame, labels: DataFrame, limit: float, risk: float) -> DataFrame:
    """(stratum, measure, cutoff, n_good, n_rejected): the admissible cutoff that rejects most, per stratum and rule.

    A rule rejects what lies above the cutoff.  Only labelled rows are gathered, and each group is combined before it is.
    """
    good = (features.select("doc_id", "stratum", F.explode(F.map_from_arrays(
        F.array(*map(F.lit, MEASURES)), F.array(*MEASURES))).alias("measure", "x"))
        .join(labels.where("quality = 1").select(F.col("doc_id"), F.lit(1).alias("good")), "doc_id"))
    grid = good.groupBy("stratum", "measure").agg(
        F.count(F.lit(1)).alias("n_good"),
        F.percentile_approx("x", [1 - 0.5 ** (k / 2 + 1) for k in range(GRID)], 10_000).alias("tries"))
    tries = grid.select("stratum", "measure", "n_good", F.explode(F.array_distinct("tries")).alias("cutoff"))
    n_tests = grid.agg((F.count(F.lit(1)) * GRID).alias("n_tests"))  # one row
    # how many good documents lie above each cutoff: one histogram of the measure by cutoffs, then sums from the top
    placed = good.join(grid.select("stratum", "measure", F.array_distinct("tries").alias("tries")), ["stratum", "measure"]).groupBy(
        "stratum", "measure", F.size(F.filter("tries", lambda c: c < F.col("x"))).alias("above")).agg(F.count(F.lit(1)).alias("n"))
    del tries
    steps = placed.groupBy("stratum", "measure").agg(F.collect_list(F.struct("above", "n")).alias("bars"))  # GRID + 1 at most
    rejected = lambda k: F.aggregate("bars", F.lit(0).cast("long"), lambda a, b: a + F.when(b["above"] > k, b["n"]).otherwise(0))
    tested = grid.select("stratum", "measure", "n_good", F.posexplode(F.array_distinct("tries")).alias("k", "cutoff")).join(
        steps, ["stratum", "measure"]).select("stratum", "measure", "n_good", "cutoff", rejected(F.col("k")).alias("n_rejected"))
    return (tested.join(F.broadcast(n_tests)).where(binomial_tail(F.col("n_good"), F.col("n_rejected"), limit) * F.col("n_tests") <= risk)
            .groupBy("stratum", "measure").agg(F.min_by(F.struct("cutoff", "n_good", "n_rejected"), "cutoff").alias("c"))
            .select("stratum", "measure", "c.*"))


def judge(docs: DataFrame, labels: DataFrame, limit: float = 0.01, risk: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, failed_rules and kept."""
    ready(docs.sparkSession)
    columns = ["doc_id", "lang", *keep]
    features = cut(measured(docs, columns).withColumn("stratum", F.coalesce("lang", F.lit(""))), "quality")
    rules = cutoffs(features.where(~base_failed()), labels, limit, risk)
    per_stratum = rules.groupBy("stratum").agg(F.collect_list(F.struct("measure", "cutoff")).alias("rules"))  # one entry per measure at most
    value = F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])
    broken = F.transform(F.filter("rules", lambda r: value[r["measure"]] > r["cutoff"]), lambda r: r["measure"])
    judged = features.join(per_stratum, "stratum", "left").withColumn("base_failed", base_failed())
    return judged.select(*dict.fromkeys(columns), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.coalesce(broken, F.array().cast("array<string>")).alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
