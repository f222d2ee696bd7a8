"""Lines around results, from the files they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, listed


def with_context(results: DataFrame, files: DataFrame, context: int) -> DataFrame:
    """The columns of ``results`` (repo, path, line, snippet, ...), first and excerpt.

    The excerpt is an array of lines of the file's content as it is in ``files`` (repo, file_path,
    content), from ``context`` lines before the snippet to as many after it, and ``first`` is the number
    of its first. Without context, or where there is no such file, it is the snippet's own lines.
    """
    own = lines(F.coalesce("snippet", F.lit("")))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("")))
    if context <= 0:
        return results.withColumns({"first": F.col("line"), "excerpt": own})
    sources = files.select(F.col("repo").alias("_repo"), F.col("file_path").alias("_path"), F.col("content").alias("_content"))
    rows = results.join(sources, (F.col("repo") == F.col("_repo")) & (F.col("path") == F.col("_path")), "left")
    rows = rows.withColumns({"_lines": lines(F.col("_content")), "_from": F.greatest(F.lit(1), F.col("line") - context)})
    many = F.greatest(F.lit(0), F.least(F.size("_lines"), F.col("line") + F.size(own) - 1 + context) - F.col("_from") + 1)
    known = F.col("_content").isNotNull()
    rows = rows.withColumns({"first": F.when(known, F.col("_from")).otherwise(F.col("line")), "excerpt": F.when(known, F.slice("_lines", F.col("_from"), many)).otherwise(own)})
    return rows.drop("_repo", "_path", "_content", "_lines", "_from")


def as_blocks(excerpts: DataFrame) -> DataFrame:
    """The columns of ``with_context`` and text: a title with place and score, and the excerpt behind line numbers."""
    title = F.format_string("%s:%s:%d  (score: %.2f)", "repo", "path", "line", "score")
    return excerpts.withColumn("text", F.concat_ws("\n", title, listed(F.col("excerpt"), F.col("first"))))
