"""The registered queries over these operators, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitalis.llm import chat_format, decontaminate, merkle, packing, parity_join, pu_classifier, quality_rules, repair_codec, secret_scan, sharding, spotsigs, substring_dedup
from orbitalis.llm.storage import input_table
from orbitalis.llm.tokens import vocabulary_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(input_table(spark, sf_dir, "documents"), vocabulary_path(), 2048, 1)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.document_sizes(input_table(spark, sf_dir, "documents"))
    dealt = sharding.shuffle_into_shards(sizes, 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = input_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    done = quality_rules.apply_rules(input_table(spark, sf_dir, "documents"), trusted)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(input_table(spark, sf_dir, "documents"), 35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(input_table(spark, sf_dir, "documents"))


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = repair_codec.write_token_files(input_table(spark, sf_dir, "documents"), vocabulary_path(), 0)
    return repair_codec.read_token_files(blocks)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.score(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = input_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest_formatted(chat_format.format_conversations(turns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similarity_classes(input_table(spark, sf_dir, "documents"), 75, 100, 5)


def op11_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(input_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(input_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": substring_dedup.ORACLE, "op8_chat": chat_format.ORACLE, "op10_jaccard": parity_join.ORACLE, "op12_merkle": merkle.oracle()}
