"""Sharding by proportional stratified interleaving, under the law "rows".

Within its source each row gets a rank in a seeded shuffle, and from it the fraction (rank + 1/2) /
rows of the source. All rows in order of this fraction are cut into shards whose counts differ by at
most one; any run of this order holds the sources in the proportions of the whole table. The
shuffle's key is a hash of the text, so equal texts of a source stand side by side and share a shard
unless a cut falls between them (the law leaves no other choice for a group above a shard's rows).

Defined results: a null text has size 1 and the checksum of the empty text; the null source is a
source; rows that agree in text and id take any order among themselves; with fewer rows than shards
some shards are empty; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank


def interleave(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed} "), text)).alias("shuffle"),
    )
    ranked = global_rank(slim, ["source"], ["shuffle", "text_crc32", "doc_id"], total="_rows")
    ranked = ranked.withColumn("_fraction", (F.col("rank") + 0.5) / F.col("_rows")).drop("rank", "_rows")
    ranked = global_rank(ranked, [], ["_fraction", "source", "doc_id", "text_crc32"], total="_rows")
    shard = F.expr(f"rank * {int(shards)} div _rows")
    ranked = ranked.withColumn("shard", shard)
    first = F.expr(f"(shard * _rows + {int(shards) - 1}) div {int(shards)}")
    return ranked.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))
