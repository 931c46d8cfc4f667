"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratewise.llm import bytebpe, chat, divergence, exact, fm, langid, lm, mixing, near, packing, phrases, pii, rules
from ratewise.llm.common import documents, table


def op1_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(documents(spark, sf_dir))


def op2_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(documents(spark, sf_dir))


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_report(chat.with_probe(table(spark, sf_dir, "conversations")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(documents(spark, sf_dir))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.find_near(documents(spark, sf_dir))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.rate_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_private_spans": op1_private_spans,
    "op2_adaptive_rules": op2_adaptive_rules,
    "op3_chat_round_trip": op3_chat_round_trip,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_attention_lm": op7_attention_lm,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_quality_fm": op9_quality_fm,
    "op10_language_bloom": op10_language_bloom,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_source_divergence": op13_source_divergence,
}
