"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (node, component), where component is the least node that links lead to.

    Rounds of large-star and small-star: each node's larger neighbours are linked to its least one,
    then its smaller neighbours. Chains shrink by about half each round and the number of links
    doesn't grow. Each round is written to the shared folder; nothing but counts reaches the driver.

    Least neighbours are written before they are joined: so both sides of the join are shuffles of
    their own, of which Spark splits a node with very many links into as many tasks as it takes.
    """

    def least_of(edges: DataFrame, name: str) -> DataFrame:
        return materialize(edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias(name), F.least("a", "_m").alias("_m")), "least")

    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = least_of(both, "_a")
        large = both.join(least, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "links")
        discard(edges, least)
        least = least_of(large, "_a")
        small = large.join(least, F.col("a") == F.col("_a"))
        small = small.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").union(least.select("_a", "_m")).distinct()
        edges = materialize(small, "links")
        discard(large, least)
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
