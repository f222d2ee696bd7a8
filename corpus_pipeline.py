"""The corpus pipeline: stages over ``documents``, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm import language, mixing, ngram_join, packing, quality
from semdex.llm.common import materialize, remainder

#: A document whose language's score is below this is rejected, as is one without any.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty.

    Null texts, and texts without a letter, go; so does all if no row has both an id and a language to
    learn from. Equal rows share their fate, whatever their ids; an empty table gives an empty one.
    """
    model = language.train(docs.filter(remainder("doc_id", 4) != 2))
    told = language.identify(docs, model, ("_language", "_language_score"))
    return told.filter((F.col("_language") != language.UNKNOWN) & (F.col("_language_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go. Each row is judged by its text alone, and keeps its columns, whatever their
    names; an empty table gives an empty one.
    """
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text")  # columns of the same names as the rules' stay apart
    judged = quality.judge(whole)
    # a filter would be pushed below the measures and work them out once for each rule that reads them
    return judged.select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Rows of one id stay or go together, and rows without an id stay, as do texts without a word. An empty
    table gives an empty one.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them.

    Rows that agree in all columns are copies of one document; others are documents of their own, even
    if they share an id or have none. Null texts have no words and are never taken. An empty table gives
    an empty one.
    """
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    A null text is an empty document, and each row is packed for itself; an empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [("language", identify_language), ("quality", quality_rules), ("near-copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Tokenizing, trained classifiers and MinHash can't be expressed in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's output is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
