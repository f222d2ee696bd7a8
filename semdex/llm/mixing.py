"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's target over its
size. Documents are put in order of size within their source, their expected copies are summed up
from the left, one offset is added, and a copy is emitted at each integer that is crossed. In order
of size, neighbours are of like length, so the words taken differ from the target by about the
longest document's.

Defined results: null texts have size 0; sources of size 0 have target 0 and nothing is taken; the
null source is a source like any other and comes last; rows that agree in source, size and id are
ranked in any order, with the same total. An empty table gives an empty result. Columns other than
those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, global_rank

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words, null counting as none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SEPARATOR_CLASS + "+"), "")).cast("long"), F.lit(0).cast("long"))


def offset_of(seed: int) -> float:
    """The offset in [0, 1) that ``seed`` stands for: a fraction of 2**32, so it has an exact decimal."""
    return int(hashlib.sha256(f"mixing {seed}".encode()).hexdigest()[:8], 16) / 2**32


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size): each source's target.

    Shares follow the weights, which repeat over the sources in order; a share above ``most`` times
    the source's size is cut to that and the excess goes to the others by weight. In order of
    cap over weight, a source is cut exactly if the level that the sources from it on would have,
    were all before it cut, is above its own cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * most
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", cap)
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_from"),
    )
    s = s.withColumn("_cut", (F.col("_all") - F.col("_before")).cast("double") * F.col("_w") > F.col("_cap").cast("double") * F.col("_from"))
    s = s.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("_cut"), F.col("_cap"))).over(everything), F.lit(0)).alias("_taken"),
        F.sum(F.when(~F.col("_cut"), F.col("_w"))).over(everything).alias("_free"),
    )
    level = (F.col("_all") - F.col("_taken")).cast("double") / F.col("_free")
    return s.select("source", "source_size", F.when(F.col("_cut"), F.col("_cap").cast("double")).otherwise(level * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 16) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    return _mixed(docs, weights, most, seed)


def _mixed(docs: DataFrame, weights: Sequence[int], most: int, seed: int, *key: Column) -> DataFrame:
    """As ``mix``, in order of ``key`` too where size and id agree, with the key's columns."""
    names = [f"_key{i}" for i in range(len(key))]
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[k.alias(n) for k, n in zip(key, names, strict=True)])
    slim = global_rank(slim, ["source"], ["size", "doc_id", *names])
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most).select(F.col("source").alias("_source"), "source_size", "target")
    rows = slim.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.lit(offset_of(seed))
    rows = rows.withColumn("copies", F.floor((F.col("rank") + 1) * each + at) - F.floor(F.col("rank") * each + at))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *names)


def _content(docs: DataFrame) -> Column:
    """A hash of the whole row; where nulls stand counts too."""
    columns = [F.col(c) for c in docs.columns]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def repeat(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 16) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, with the columns of ``docs``.

    Only rows that agree in all columns count as one document here.
    """
    key = ["doc_id", "source", "_size", "_content"]
    copies = _mixed(docs, weights, most, seed, _content(docs)).withColumnsRenamed({"size": "_size", "_key0": "_content"})
    copies = copies.groupBy(*key).agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    copies = copies.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_copies")
    same = F.lit(True)
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = docs.withColumns({"_size": word_count(F.col("text")), "_content": _content(docs)}).dropDuplicates(key).join(copies, same)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
