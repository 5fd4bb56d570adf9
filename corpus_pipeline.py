"""A training corpus from raw documents: five stages, each by one of the operators of ``runledger.llm``.

Every stage but the last returns the columns of ``documents``.  A document is known by its
doc_id and a fingerprint of its text, so rows that repeat both are one document.

* Quality rules: rejected documents go.
* Line dedup: duplicate lines go; a document goes if that leaves it no text.
* N-gram Jaccard join: one document of each class of near duplicates stays.
* Benchmark decontamination: documents with a benchmark passage go.
* Best-fit packing: the pieces of the rest, placed in sequences.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.lineage import cut
from runledger.llm import decontaminate, jaccard, linededup, packing, quality
from runledger.llm.common import table


def _matched(docs: DataFrame, found: DataFrame, how: str, *more: str) -> DataFrame:
    """Documents with (semi) or without (anti) a row in ``found`` of the same doc_id and print, or (inner, left) its other columns too."""
    own = docs.withColumn("__print", F.xxhash64("text")).alias("d")
    other = found.select(F.col("doc_id").alias("__id"), F.col("print").alias("__other"), *[F.col(c).alias(f"__{c}") for c in more]).alias("f")
    return own.join(other, F.col("d.doc_id").eqNullSafe(F.col("f.__id")) & (F.col("d.__print") == F.col("f.__other")), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs.withColumn("print", F.xxhash64("text")), table(spark, sf_dir, "labels"), keep=("print",))
    return _matched(docs, judged.where("kept"), "left_semi").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.deduplicate(docs, least=1).where("size(removed) > 0")
    joined = _matched(docs, found, "left", "removed")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(left)
    return (joined.withColumn("text", text).where("__removed IS NULL OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
            .withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = jaccard.classes(docs).groupBy("doc_id", "print").agg(F.max("kept").alias("kept"), F.count("*").alias("n_rows"))
    # documents to drop, and those whose rows repeat; all others, usually nearly all, need not be moved to be kept
    others = cut(judged.where("NOT kept OR n_rows > 1"), "not-single")
    single = _matched(docs, others, "left_anti").select(*docs.columns)
    return single.unionByName(_matched(docs, others.where("kept"), "left_semi").dropDuplicates(["doc_id", "__print"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "print").distinct()
    return _matched(docs, cut(found, "contaminated"), "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Edit distances, components and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), re.sub("[^a-z]+", "-", name.lower()))
    return STAGES[-1][1](spark, docs, sf_dir)
