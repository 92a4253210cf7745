"""The training-corpus pipeline: five stages, each over all rows that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents.  ``run`` applies them to the documents table and
cuts lineage between stages through tables in the session's shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from quarry.llm.queries import VOCABULARY
from quarry.plans.scratch import Scratch, released
from quarry.plans.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken twice has two rows."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    codec = bpe.codec_for(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    got = bpe.with_tokens(docs, codec, keep=["doc_id", "source", "text"])
    return got.select(
        "doc_id",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", tokenize),
]

#: A learned model decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with released():  # what a stage wrote for itself goes once its outcome is stored
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
