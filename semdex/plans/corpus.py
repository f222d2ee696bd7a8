"""The supplied tables seen as the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS, ENDINGS = ("python", "java", "go", "text"), ("py", "java", "go", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunks of files of ten repos."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("vec_id") % 4).cast("int"))
    path = F.concat(F.lit("src/m"), F.col("vec_id") % 7, F.lit("/f"), F.col("vec_id") % 50, F.lit("."), pick(ENDINGS))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("repo"), F.col("label")).alias("repo"), path.alias("file_path"),
        F.col("vec_id").cast("int").alias("line_start"), (F.col("vec_id") + 9).cast("int").alias("line_end"),
        F.concat(F.lit("chunk "), F.col("vec_id")).alias("content"), pick(LANGS).alias("lang"), "embedding",
    )


#: The same in DuckDB.
VECTOR_CHUNKS = """
vc AS (SELECT vec_id AS id, 'repo' || label AS repo,
  'src/m' || (vec_id % 7) || '/f' || (vec_id % 50) || '.' || ['py', 'java', 'go', 'txt'][(vec_id % 4 + 1)::INT] AS file_path,
  vec_id::INT AS line_start, (vec_id + 9)::INT AS line_end, 'chunk ' || vec_id AS content,
  ['python', 'java', 'go', 'text'][(vec_id % 4 + 1)::INT] AS lang, embedding::DOUBLE[] AS e FROM embeddings)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: repo, file_path, content, mtime, length."""
    ending = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "GO").when(F.col("lang") == "fr", "yml").otherwise("md")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo"), F.concat("lang", F.lit("/"), "doc_id", F.lit("."), ending).alias("file_path"),
        F.col("text").alias("content"), F.col("doc_id").cast("double").alias("mtime"), F.octet_length("text").cast("long").alias("length"),
    )


FILES = """
f AS (SELECT doc_id, source AS repo, lang || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'GO' WHEN 'fr' THEN 'yml' ELSE 'md' END AS file_path,
  text AS content, doc_id::DOUBLE AS mtime, strlen(text)::BIGINT AS length FROM documents)"""
