"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carequeue.llm import (
    chat,
    fertility,
    mixing,
    near_duplicates,
    personal_data,
    quality,
    sentencepiece_spans,
    simhash,
    suffix_dedup,
    token_counts,
    vector_codes,
    whitening,
    winnowing,
)
from carequeue.llm.oracle import LLM_ORACLE
from carequeue.sources.tables import load_table

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed, on the driver and every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "documents")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(mixing.mix_plan(documents(spark, folder)))


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(documents(spark, folder))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, folder))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_spans.encoded_documents(
        documents(spark, folder), tokenizer_path(PIECE_MODEL)
    )


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, folder))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(documents(spark, folder), load_table(spark, folder, "labels"))


def op7_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.quality_rules(documents(spark, folder), tokenizer_path(PIECE_MODEL))


def op8_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.fingerprinted_documents(documents(spark, folder))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted_documents(documents(spark, folder), tokenizer_path(WORD_MODEL))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one, -7, whose texts are control strings."""
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)],
        "conv_id long, turn long, role string, text string",
    )
    rows = load_table(spark, folder, "conversations")
    rows = rows.select("conv_id", "turn", "role", "text").union(added)
    formatted = chat.format_paths(chat.linear_messages(rows))
    return chat.digests(chat.read_back(formatted))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, folder))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.vector_codes(load_table(spark, folder, "embeddings"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_embeddings(load_table(spark, folder, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_personal_data": op2_personal_data,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality": op6_quality,
    "op7_fertility": op7_fertility,
    "op8_winnowing": op8_winnowing,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}
