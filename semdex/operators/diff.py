"""What changed between a scan and an index, and the tables' upkeep that follows from it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(file_path, mtime): the latest mtime of each indexed file."""
    return chunks.groupBy("file_path").agg(F.max("file_mtime").alias("mtime"))


def diff_files(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """(file_path, status) of (file_path, mtime) tables: new, changed, removed or unchanged."""
    s, i = scanned.select("file_path", F.col("mtime").alias("_now")), indexed.select("file_path", F.col("mtime").alias("_then"))
    status = (
        F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.abs(F.col("_now") - F.col("_then")) > TOLERANCE, "changed").otherwise("unchanged")
    )
    return s.join(i, "file_path", "full_outer").select("file_path", status.alias("status"))


def without_files(table: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("repo_id", "file_path")) -> DataFrame:
    """The rows whose file isn't among those gone."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def repo_stats(chunks: DataFrame, by: str = "repo_id") -> DataFrame:
    return chunks.groupBy(by).agg(F.count_distinct("file_path").alias("file_count"), F.count(F.lit(1)).alias("chunk_count"))


def upsert(entries: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The latest entry of each key."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_last")).select(key, "_last.*")


def running_sums(rows: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in order of unique ``keys``.

    Rows are range-partitioned by the keys and summed up within their partition; one row for each
    partition goes through a window of all. The ranges are kept while both are read.
    """
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranged = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_s"))
    parts = parts.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    summed = ranged.join(F.broadcast(parts), F.col("_part") == F.col("_p"))  # a row for each partition
    return summed.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_p", "_before")


def assign_ids(chunks: DataFrame, highest: int | Column, file: tuple[str, ...] = ("repo_id", "file_path"), order: tuple[str, ...] = ("line_start",)) -> DataFrame:
    """Add ids above ``highest``, in order of file and place in it.

    Rows are numbered within their file; files get offsets from their counts.
    """
    within = Window.partitionBy(*file).orderBy(*order)
    counts = chunks.groupBy(*file).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_sums(counts, file, "_n", "_offset").drop("_n")
    top = F.lit(highest) if isinstance(highest, int) else highest
    rows = chunks.withColumn("_row", F.row_number().over(within)).join(offsets, list(file))
    return rows.withColumn("id", (top + F.col("_offset") + F.col("_row")).cast("long")).drop("_row", "_offset")


def repo_at(repos: DataFrame, directory: str) -> DataFrame:
    """(name, glob) of the deepest repo that holds the directory; glob is null at its root. No row if none does."""
    at = directory.rstrip("/") or "/"
    root = F.when(F.col("path") == "/", F.lit("/")).otherwise(F.concat(F.rtrim(F.col("path"), F.lit("/")), F.lit("/")))
    inside = repos.filter((F.col("path") == at) | F.lit(at).startswith(root))
    best = inside.agg(F.max_by(F.struct("name", "path"), F.length("path")).alias("_r")).filter("_r IS NOT NULL")
    below = F.substring(F.lit(at), F.length("_r.path") + 1, F.lit(len(at)))
    glob = F.when(F.col("_r.path") == at, F.lit(None)).otherwise(F.concat(F.ltrim(below, F.lit("/")), F.lit("/*")))
    return best.select("_r.name", glob.alias("glob"))
