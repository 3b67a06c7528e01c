"""A training-data pipeline: rated quality, near-duplicates, repeated passages, secrets, packing.

Every stage reads what its predecessor wrote as Parquet and works on all of it. All stages but the last
return the columns of ``documents``.

Defined results: a null or empty text is graded like any other and is no copy of anything; the third stage drops it, as it drops texts that consist of
repeated passages only; very long texts go through whole; of rows with equal or near-equal texts one stays, rows that share an id but not a text are judged apart; columns
other than those of ``documents`` are dropped at once; an empty table, or one of which nothing is kept, gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import near_dedup, packing, quality_model, secret_scan, substring_dedup
from docloom.llm.common import shared_path
from docloom.llm.queries import GOOD, packing_digest, trained_grader, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half; the grader is fitted on the labels."""
    docs = docs.select(COLUMNS)
    return quality_model.keep_good(docs, trained_grader(spark, docs, sf_dir), GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on five-word shingles): the one with the least id."""
    return near_dedup.drop_copies(docs.select(COLUMNS), percent=80, matches=30)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere; texts left empty go."""
    return substring_dedup.strip_repeats(docs.select(COLUMNS)).where("text != ''").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also encoded ones, replaced by a mask."""
    return secret_scan.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    return packing_digest(packing.pack_documents(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("quality classifier", grade), ("near-duplicates", drop_near_duplicates), ("repeated passages", remove_repeated_passages), ("secret scan", redact_secrets), ("packing", pack)]

#: The first stage is a fitted model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = shared_path(spark, name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
