"""The thin queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import chat, decontam, divergence, jaccard, langid, packing, pii, repair, simhash, spotsigs, substrings, tokens, toxicity
from codequarry.llm.common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.windows(chat.with_special(spark, table(spark, sf_dir, "conversations"))))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damage(conversations)), conversations)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.compare_sources(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


QUERIES = {"op1_chat": op1_chat, "op2_token_counts": op2_token_counts, "op3_suffix_array": op3_suffix_array, "op4_decontamination": op4_decontamination, "op5_pii": op5_pii, "op6_jaccard": op6_jaccard, "op7_toxicity": op7_toxicity, "op8_spotsigs": op8_spotsigs, "op9_language": op9_language, "op10_packing": op10_packing, "op11_repair": op11_repair, "op12_divergence": op12_divergence, "op13_simhash": op13_simhash}

ORACLE: dict[str, str] = {"op1_chat": chat.ORACLE, "op8_spotsigs": spotsigs.ORACLE, "op11_repair": repair.ORACLE, "op12_divergence": divergence.ORACLE}
