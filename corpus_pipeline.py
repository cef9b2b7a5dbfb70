"""A training corpus in five stages, each on all that the one before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents, whatever more of
them docs has and whatever their names. Null and empty texts are rejected by the first; rows of null
ids go through all of them; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.jaccard_join import drop_near_duplicates
from inkwell.llm.mixing import mix_sources
from inkwell.llm.packing import pack_in_file_order
from inkwell.llm.pseudonyms import pseudonymise, secret_key
from inkwell.llm.quality_mil import keep_quality
from inkwell.session import ship, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier doesn't reject."""
    return keep_quality(docs, table(ship(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship(spark)
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as pseudonyms under the session's key (spark.inkwell.pseudonym.secret)."""
    return pseudonymise(docs, secret_key(ship(spark)), report=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, some more than once, in the order of training; the files keep the order."""
    ship(spark)
    return mix_sources(docs, carry=True, report=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, in the order in which docs was written."""
    ship(spark)
    return pack_in_file_order(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read again. The
    folders go when the application ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained model and tokenizers decide what is kept, which SQL can't express; tests hold the
# stages against brute force.
ORACLE_SQL = None
