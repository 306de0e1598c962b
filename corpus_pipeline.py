"""Corpus cleaning as five stages over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrove.llm import common, linededup, mixing, packing, simhash, toxicity


# Each stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
# columns of clashing names as its operator says; rows that an operator doesn't judge are kept, but mixing
# ends at its budget and packing gives no row to texts without words.


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the model is fitted on docs with the table labels."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; those of which nothing is left go."""
    return linededup.dedup(docs).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all documents that have none.

    Copies whose lines the stage before took out are no longer alike, so the texts count as they
    were in the table documents, too; of its rows only those that docs still has.
    """
    return simhash.drop_near_copies(docs, common.read(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by mixing.WEIGHTS, of half of all tokens, in order of finish time."""
    return mixing.mix(docs, mixing.WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or of each of its pieces, in bins of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The trained scores, the signatures and the local search have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written as Parquet in the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    before = ()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name, before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
