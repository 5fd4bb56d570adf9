"""The registered queries of this subpackage: name -> (function of session and folder, checking SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import chat, crosstoken, decontaminate, jaccard, linededup, packing, personal, quality, secrets, structure, suffixdedup, tokenfiles, urls
from runledger.llm.common import table


def _vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same package is installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = linededup.deduplicate(docs, least=1).select(
        F.col("doc_id").alias("__id"), F.col("print").alias("__print"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_links",
        F.array_join("removed", ",").alias("removed_lines"), F.array_join("line_classes", ",", "").alias("line_classes"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("__own"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__print"))).drop("__id", "__print", "__own")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return tokenfiles.read_documents(manifest)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).drop("print")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS]
    return scanned.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = personal.scan(table(spark, sf_dir, "documents"))
    counts = [personal.count_of(F.col("base"), k).alias(f"n_{k}") for k in personal.KINDS]
    return scanned.select("doc_id", *counts, F.sha2(personal.written(F.col("base")), 256).alias("base_sha256"), personal.written(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("lang").withColumn(
        "failed_rules", F.array_join("failed_rules", ","))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosstoken.align(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                             F.lit(chat.PLANTED).alias("text"))
    read = chat.read_back(chat.turns(given.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reports(structure.repair(structure.damage(table(spark, sf_dir, "conversations"))))


QUERIES: dict = {
    "op1_decontamination": (op1_decontamination, None),
    "op2_line_dedup": (op2_line_dedup, None),
    "op3_token_files": (op3_token_files, None),
    "op4_jaccard_join": (op4_jaccard_join, None),
    "op5_suffix_array_dedup": (op5_suffix_array_dedup, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_best_fit_packing": (op7_best_fit_packing, None),
    "op8_personal_data": (op8_personal_data, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_url_filter": (op10_url_filter, urls.CHECK),
    "op11_cross_tokenizer": (op11_cross_tokenizer, None),
    "op12_chat_format": (op12_chat_format, chat.CHECK),
    "op13_structure_repair": (op13_structure_repair, None),
}
