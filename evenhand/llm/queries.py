"""The registered query of each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evenhand.llm import oracle
from evenhand.llm.common import documents

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.jaccard import with_components

    return with_components(documents(spark, sf_dir))


def op2_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.embeddings import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.decontaminate import report

    return report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_hash")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.secrets import secret_spans

    return secret_spans(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.lines import line_report

    return line_report(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.pfor import token_files

    return token_files(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.bpe import encode_decode_digests

    return encode_decode_digests(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.transducer import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.quality import fit, score

    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.substrings import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.alignment import align_tokenizers

    return align_tokenizers(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.mixing import mixture_report

    return mixture_report(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenhand.llm.merkle import tamper_check

    return tamper_check(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_embedding_near_dups, op3_decontamination, op4_secrets, op5_line_dedup, op6_token_files,
                            op7_bpe_round_trip, op8_token_counts, op9_quality_rules, op10_repeated_strings, op11_tokenizer_alignment, op12_source_mix, op13_merkle_manifest)
}
SQL: dict[str, str] = {"op1_ngram_jaccard": oracle.NGRAM_JACCARD, "op2_embedding_near_dups": oracle.NEAR_VECTORS, "op3_decontamination": oracle.DECONTAMINATION, "op5_line_dedup": oracle.LINES,
                       "op12_source_mix": oracle.SOURCE_MIX, "op13_merkle_manifest": oracle.MERKLE}
