"""The contract's queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, chat, decontamination, exact_dedup, fingerprints, hard_negatives, language_id, mixing, near_dups, pii, quality, url_filters, whitening
from twinsift.runtime import table

try:
    import public_tokenizers

    #: The vocabulary that the queries use; the operator takes any path.
    VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:
    VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_classes(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.chat(chat.conversations_with_probe(spark, sf_dir)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contaminated_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(table(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(whitening.quantised(table(spark, sf_dir, "embeddings"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filters, op2_language_id, op3_pii, op4_mixing, op5_fingerprints, op6_quality, op7_near_dups, op8_chat_formatting, op9_bpe, op10_exact_dedup, op11_decontamination, op12_hard_negatives, op13_whitening)}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": url_filters.op1_sql(),
    "op8_chat_formatting": chat.op8_sql(),
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_decontamination": decontamination.op11_sql(),
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
