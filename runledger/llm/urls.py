"""URL filtering by a Bloom filter cascade.

A cascade answers membership exactly for every key of a known universe: level 0 encodes the
listed keys, level 1 the keys of the universe that level 0 takes for listed by mistake, level 2
the listed keys that level 1 takes for mistakes, and so on until a level errs nowhere.  A key's
answer is the parity of the first level that does not hold it.  The universe is all keys of
the corpus, so pages are judged without joining them to a list.  Cascades are dealt into blocks by
key so that each has at most ``BLOCK_BYTES``, which bounds what is sent to a task.

Defined results: null urls and urls without "://" have an empty host and path, no rule and the verdict allow;
pages that repeat a page_id or url are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm.common import mixed, ready

#: Fixed by the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

BITS_PER_KEY = 8
HASHES = 4
BLOCK_BYTES = 16 << 20
MOST_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_keys(host: Column, path: Column, labels: int, folders: int) -> Column:
    """Keys under which rules for a url may be listed: the last labels of its host, each with the first folders of its path."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    steps = F.split(path, "/")
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.lit(folders)), lambda n: n < F.size(steps)),
                           lambda n: F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/")))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    a = mixed(h1 + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return [((a + np.uint64(i) * (h2 | np.uint64(1))) >> np.uint64(11)) % np.uint64(size) for i in range(HASHES)]


def _held(level: int, filt: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for at in _bits(h1, h2, level, len(filt) * 64):
        out &= (filt[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def member(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed, by the parity of the first level that does not hold it."""
    answer, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for level, filt in enumerate(levels):
        held = np.zeros(len(h1), bool)
        held[open_] = _held(level, filt, h1[open_], h2[open_])
        answer[open_ & ~held] = level % 2 == 1
        open_ &= held
    answer[open_] = len(levels) % 2 == 1
    return answer


def _level(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """One level's bits, combined in Spark word by word."""
    words = max(1, -(-n * BITS_PER_KEY // 64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            at = np.concatenate(_bits(h1, h2, level, words * 64))
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.record_batch({"word": pa.array(word.view(np.int64)), "bits": pa.array(bits.view(np.int64))})

    got = keys.select("h1", "h2").mapInArrow(encode, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # BLOCK_BYTES at most
    out = np.zeros(words, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def build_cascade(universe: DataFrame) -> list[np.ndarray]:
    """Levels over keys (h1, h2, listed).  The sets of a level are re-read from the stored universe, so nothing is gathered but bits."""
    spark, levels = universe.sparkSession, []
    remaining = {True: universe.where("listed"), False: universe.where("NOT listed")}
    for level in range(MOST_LEVELS):
        side = level % 2 == 0
        n = remaining[side].count()
        if not n:
            return levels
        levels.append(_level(remaining[side], level, n))
        sent = spark.sparkContext.broadcast((level, levels[-1]))
        wrong = remaining[not side].mapInArrow(_survivors(sent), "h1 long, h2 long, listed boolean")
        remaining[not side] = cut(wrong, f"cascade-{level}")
    raise ValueError("two keys agree in 128 bits")


def _survivors(sent):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, filt = sent.value
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            yield batch.filter(pa.array(_held(level, filt, h1, h2)))

    return keep


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def cascades(universe: DataFrame, listed: DataFrame) -> list[list[np.ndarray]]:
    """A cascade per block for a universe of keys and the listed ones among them (both with a column key)."""
    ready(universe.sparkSession)
    both = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    keyed = cut(both.groupBy("key").agg(F.max("listed").alias("listed")).select(*hashed(F.col("key")), "listed"), "key-universe")
    blocks = max(1, -(-keyed.where("listed").count() * BITS_PER_KEY // 8 // BLOCK_BYTES))
    return [build_cascade(keyed.where(F.pmod("h1", F.lit(blocks)) == b)) for b in range(blocks)]


def is_listed(df: DataFrame, keys: str, levels: list[list[np.ndarray]], name: str) -> DataFrame:
    """Adds ``name``: for an array column of keys, the array of those listed.  Each block of the cascade is sent on its own."""
    out = df.withColumn(name, F.array().cast("array<string>"))
    for b, block in enumerate(levels):
        sent, n = df.sparkSession.sparkContext.broadcast(block), len(levels)

        @F.pandas_udf("array<boolean>")
        def probe(h1: pd.Series, h2: pd.Series) -> pd.Series:
            sizes = h1.map(len).to_numpy()
            flat1, flat2 = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64) for x in (h1, h2))
            yes = member(sent.value, flat1, flat2) if sent.value else np.zeros(len(flat1), bool)
            yes &= (flat1.view(np.int64) % n) == b
            return pd.Series([*np.split(yes, np.cumsum(sizes)[:-1])][:len(sizes)], dtype=object)

        asked = F.transform(F.col(keys), lambda k: F.xxhash64(k)), F.transform(F.col(keys), lambda k: F.xxhash64(F.lit("second"), k))
        out = out.withColumn("__yes", probe(*asked)).withColumn(name, F.concat(name, F.filter(F.col(keys), lambda k, i: F.get("__yes", i)))).drop("__yes")
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (the longest that fits), verdict.

    Where no rule fits, a host is blocked as a whole if the rules block more than half of its pages.
    """
    if any(not p.startswith("/") or not p.endswith("/") for _, _, p in rules):
        raise ValueError("a rule's path starts and ends with /")
    spark = pages.sparkSession
    ready(spark)
    labels, folders = max(h.count(".") + 1 for _, h, _ in rules), max(p.count("/") for _, _, p in rules)
    host, path = url_parts(F.col("url"))
    split = cut(pages.select("page_id", host.alias("host"), path.alias("path")), "urls").withColumn(
        "keys", rule_keys(F.col("host"), F.col("path"), labels, folders))
    universe = split.select(F.explode("keys").alias("key")).distinct()
    ruled = split
    for verdict in ("block", "allow"):
        own = spark.createDataFrame([(h + p,) for v, h, p in rules if v == verdict], "key string")
        ruled = is_listed(ruled, "keys", cascades(universe, own), verdict)
    longest = lambda c: F.aggregate(c, F.lit(""), lambda a, k: F.when(F.length(k) > F.length(a), k).otherwise(a))
    ruled = cut(ruled.withColumn("block", longest("block")).withColumn("allow", longest("allow")).select(
        "page_id", "host", "path", F.greatest(F.length("block"), F.length("allow")).alias("size"),
        F.when(F.length("block") > F.length("allow"), F.col("block")).otherwise(F.col("allow")).alias("rule"),
        F.when(F.length("block") > F.length("allow"), "block").otherwise("allow").alias("verdict")), "ruled")
    hosts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("size") > 0) & (F.col("verdict") == "block")).alias("blocked"))
    listed = hosts.where("2 * blocked > n AND host <> ''")
    levels = cascades(hosts.select(F.col("host").alias("key")), listed.select(F.col("host").alias("key")))
    return is_listed(ruled.withColumn("keys", F.array("host")), "keys", levels, "listed").select(
        "page_id", "host", "path", F.when(F.col("size") > 0, F.col("rule")).alias("rule"),
        F.when(F.col("size") > 0, F.col("verdict")).when(F.size("listed") > 0, "block").otherwise("allow").alias("verdict"))


CHECK = """
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS rid, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY rid),
j AS (SELECT q.page_id, q.host, q.path, fit.rule, fit.verdict FROM q LEFT JOIN fit USING (rid)),
h AS (SELECT host, 2 * count(*) FILTER (verdict = 'block') > count(*) AND host <> '' AS listed FROM j GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN h.listed THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN h USING (host)
"""
