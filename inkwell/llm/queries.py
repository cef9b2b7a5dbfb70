"""One registered query an operator, over its whole table with production parameters, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread, table
from . import (
    fertility,
    jaccard_join,
    licenses,
    mixing,
    packing,
    prefix_counts,
    pseudonyms,
    quality_mil,
    telephony,
    token_output,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(ship(spark), sf_dir, "documents"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_tokens(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each document's bytes stand for a call, in one of the three codecs."""
    docs = documents(spark, sf_dir)
    codec = F.element_at(F.array(*map(F.lit, ("mulaw", "alaw", "adpcm"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return telephony.decode_telephony(
        docs.select("doc_id", F.col("text").cast("binary").alias("payload"), codec.alias("codec"))
    )


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(documents(spark, sf_dir))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), pseudonyms.secret_key(spark))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.prefix_counts(documents(spark, sf_dir))


def op7_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.withColumn("position", F.round("position", 6))


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class and number of links."""
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_license_scan,
        op3_telephony_audio,
        op4_tokeniser_fertility,
        op5_feistel_pseudonyms,
        op6_prefix_token_counts,
        op7_ordered_packing,
        op8_curriculum_mixing,
        op9_attention_quality,
        op10_ngram_jaccard_join,
    )
}

# The other nine run tokenizers, codecs, compressors, ciphers, dynamic programs or a trained
# model, which SQL can't express; op10's SQL would compare all pairs. Tests hold them against
# brute force instead.
ORACLES = {"op8_curriculum_mixing": mixing.oracle()}
