"""A training corpus from documents: toxic ones go, repeated lines go, near duplicates go, personal data is replaced, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run writes what a stage returns as Parquet and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import jaccard, line_dedup, packing, pii, toxicity
from lamina.llm.shared import stored

TOXIC_FROM = 0.7
#: Pieces whose ids a Python worker keeps in the last stage: by then the executors' JVMs have grown to their full size.
PIECES_KEPT = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score >= TOXIC_FROM) go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs, model, TOXIC_FROM)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go; so do documents of which no line is left."""
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates."""
    return pii.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of a document in one."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=PIECES_KEPT)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("pii", replace_private), ("packing", pack)]

#: SQL can't express the classifier, the surrogates or the tokeniser. Tests hold the operators of the stages against plain
#: versions one by one, and run the stages in a row on a small table, odd rows and an empty table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
