"""A corpus from raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes each stage's rows as Parquet in the shared checkpoint
folder and reads them again as the next one's documents.

Every stage takes nulls in any column, repeated rows and ids, and columns named
like those that an operator adds; all but the last give the columns they got.  A
null or empty text has no words: the quality rules reject it.  An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.blocks import importable, stored
from jobsift.llm.positional_index import clean_documents
from jobsift.llm.quality_rules import kept_documents
from jobsift.llm.sentence_pieces import encode
from jobsift.llm.simhash_dedup import one_of_each
from jobsift.llm.substring_dedup import kept_or_text, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep.  Null, empty and
    short texts fail the base rule; repeated rows are judged alike; without usable
    labels only the base rule judges."""
    importable(spark)
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one with the smallest id.  Texts
    without words have one fingerprint, so one of them stays."""
    importable(spark)
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document's windows cover;
    ``n_chars`` follows the text.  One of which nothing is left stays, empty."""
    importable(spark)
    cut = substring_dedup(docs)
    text = kept_or_text(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(
        F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.withColumns(new).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.  A text without words
    is clean; without benchmark items all are."""
    importable(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and N best segmentations of each document; a null text has no
    pieces and is restored as null."""
    importable(spark)
    encoded = encode(docs.select("doc_id", "lang", "source", "text"), restored="decoded")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "nbest",
                          F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: Learned rules, XXH64 fingerprints and piece lattices are not for SQL; the
#: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
