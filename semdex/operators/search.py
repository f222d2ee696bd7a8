"""Filtered nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatchError
from ..functions import vectors
from ..functions.globs import matches


def _filter(repo: str | None, langs: Sequence[str] | None, path_glob: str | None) -> Column | None:
    parts = []
    if repo is not None:
        parts.append(F.col("repo") == repo)
    if langs:
        parts.append(F.col("lang").isin(list(langs)))
    if path_glob:
        parts.append(matches(F.col("file_path"), path_glob))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


#: Results that are broadcast to where their texts are; more are joined by a shuffle.
BROADCAST_RESULTS = 10_000
#: Queries that are broadcast to all rows.
MOST_BROADCAST = 1_000


def _results(rows: DataFrame, threshold: float, limit: int, texts: DataFrame | None = None) -> DataFrame:
    order = [F.col("score").desc(), "repo", "file_path", "line_start", "id"]
    rows = rows.withColumn("score", vectors.score(F.col("_distance"))).filter(F.col("score") >= threshold)
    rows = rows.orderBy(*order).limit(limit)
    if texts is not None:
        rows = texts.join(F.broadcast(rows) if limit <= BROADCAST_RESULTS else rows, "id").orderBy(*order)
    return rows.select("repo", F.col("file_path").alias("path"), F.col("line_start").alias("line"), "score", F.col("content").alias("snippet"), F.coalesce("lang", F.lit("")).alias("lang"))


def check_width(expected: int | None, query: Sequence[float]) -> None:
    if expected is not None and len(query) != expected:
        raise DimensionMismatchError(f"the index holds vectors of width {expected}, the query has {len(query)}; re-index in full")


def search(
    chunks: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.0, repo: str | None = None,
    langs: Sequence[str] | None = None, path_glob: str | None = None, candidate_cap: int | None = None,
) -> DataFrame:
    """The best chunks for a query vector, by score, then repo, path and line.

    ``chunks`` has id, repo, file_path, line_start, content, lang and embedding. Without filters, the
    ``limit`` nearest are taken and then put in order, so among chunks whose score is 0 the nearest
    are taken. With filters, these are applied before the nearest are taken, unless
    ``candidate_cap`` asks for the filters to see that many nearest chunks only.
    """
    if limit <= 0:
        return _results(chunks.withColumn("_distance", F.lit(0.0)), threshold, 0)
    rows = chunks.withColumn("_distance", vectors.l2(F.col("embedding"), vectors.literal(query)))
    wanted = _filter(repo, langs, path_glob)
    nearest = [F.col("_distance").asc(), F.col("id").asc()]
    if wanted is None:
        return _results(rows.orderBy(*nearest).limit(limit), threshold, limit)
    if candidate_cap is not None:
        rows = rows.orderBy(*nearest).limit(max(limit, candidate_cap))
    return _results(rows.filter(wanted), threshold, limit)


def search_stored(
    places: DataFrame, embeddings: DataFrame, texts: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.0, repo: str | None = None,
    langs: Sequence[str] | None = None, path_glob: str | None = None,
) -> DataFrame:
    """As ``search``, over places (id, repo, file_path, line_start, lang), embeddings (id, embedding) and texts (id, content).

    Without filters, the nearest vectors are found before anything is joined; with filters, only what
    passes them is. Texts are joined to the results alone. Chunks without a vector aren't found.
    """
    wanted = _filter(repo, langs, path_glob)
    distance = embeddings.filter("embedding IS NOT NULL").select("id", vectors.l2(F.col("embedding"), vectors.literal(query)).alias("_distance"))
    if wanted is not None:
        return _results(places.filter(wanted).join(distance, "id"), threshold, max(0, limit), texts)
    nearest = distance.orderBy(F.col("_distance").asc(), F.col("id").asc()).limit(max(0, limit))
    return _results(places.join(F.broadcast(nearest) if limit <= BROADCAST_RESULTS else nearest, "id"), threshold, max(0, limit), texts)


def search_many(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of each query (query_id, query): query_id, id, score, rank.

    The queries are broadcast, after a count; beyond ``MOST_BROADCAST`` of them, blocks are compared. Each
    task keeps k chunks for each query before anything is shuffled.
    """
    if queries.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return search_blocks(chunks, queries, k)
    rows = chunks.select("id", "embedding").join(F.broadcast(queries.select("query_id", "query")), F.lit(True))
    rows = rows.select("query_id", "id", vectors.l2(F.col("embedding"), F.col("query")).alias("_distance"))
    order = Window.partitionBy("query_id").orderBy("_distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", vectors.score(F.col("_distance")).alias("score"), "rank")


#: Vectors of a block; a task compares a block of queries with a block of rows.
QUERY_BLOCK, ROW_BLOCK = 256, 4096


def _blocks(rows: DataFrame, size: int, side: str) -> DataFrame:
    """(ids, vectors) for each ``size`` rows (id, vector) of a partition, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = np.asarray(part.column(1).flatten(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column(0)).tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], [f"ids_{side}", f"vectors_{side}"])

    return rows.mapInArrow(run, f"ids_{side} binary, vectors_{side} binary")


#: Numbers of the vectors whose exact distances are worked out at a time.
EXACT_AT_ONCE = 4_000_000


def _exact(x: np.ndarray, q: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of the pairs, summed up in the order of ``vectors.l2``, so they equal its bit for bit."""
    out, step = np.empty(len(of)), max(1, EXACT_AT_ONCE // max(1, x.shape[1]))
    for i in range(0, len(of), step):
        squares = (x[at[i : i + step]] - q[of[i : i + step]]) ** 2
        out[i : i + step] = np.sqrt(np.cumsum(squares, 1)[:, -1])
    return out


def _met(rows: DataFrame, asked: DataFrame, k: int, keys: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], clamped: bool = False) -> DataFrame:
    """(query_id, id, _distance): the first k rows of each query in each pair of a block of rows and one of queries.

    ``keys`` has the order, the last key first, of ids, places in the block and distances. ``clamped``:
    all rows at a distance of 2 and beyond are equal but for these keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, asked = (np.frombuffer(row[f"ids_{s}"], np.int64) for s in "rq")
                x, q = (np.frombuffer(row[f"vectors_{s}"], np.float64).reshape(len(i), -1) for s, i in (("r", ids), ("q", asked)))
                if len(ids) > k:  # all that may be among the k nearest, ties and what isn't a number too; then exact distances
                    with np.errstate(invalid="ignore"):
                        near = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
                        bound = np.partition(near, k - 1, 1)[:, k - 1 : k]
                        bound = bound + 1e-9 * (1 + np.abs(bound) + (q * q).sum(1)[:, None])
                        of, at = np.nonzero(~(near > (np.where(bound >= 4, np.inf, bound) if clamped else bound)))
                else:
                    of, at = np.nonzero(np.ones((len(asked), len(ids)), bool))
                distance = _exact(x, q, of, at)
                order = np.lexsort((*keys(ids[at], at, distance), of))
                of, at, distance = of[order], at[order], distance[order]
                best = np.arange(len(of)) - np.searchsorted(of, of) < k
                yield pa.RecordBatch.from_arrays([pa.array(asked[of[best]]), pa.array(ids[at[best]]), pa.array(distance[best])], ["query_id", "id", "_distance"])

    return rows.crossJoin(asked).mapInArrow(run, "query_id long, id long, _distance double")


def _row_blocks(rows: DataFrame) -> DataFrame:
    return _blocks(rows.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>")), ROW_BLOCK, "r")


def _query_blocks(queries: DataFrame) -> DataFrame:
    return _blocks(queries.select(F.col("query_id").cast("long"), F.col("query").cast("array<double>")), QUERY_BLOCK, "q")


def search_blocks(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``search_many``, for queries of any number: blocks of queries meet blocks of rows.

    Each pair of blocks keeps the k nearest rows of each query; ids and vectors aren't null.
    """
    found = _met(_row_blocks(chunks), _query_blocks(queries), k, lambda ids, at, distance: (ids, distance.round(9)))
    order = Window.partitionBy("query_id").orderBy(F.round("_distance", 9), "id")  # equal distances, whatever order they were summed up in
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", vectors.score(F.col("_distance")).alias("score"), "rank")


def search_stored_many(
    places: DataFrame, embeddings: DataFrame, texts: DataFrame, queries: DataFrame, limit: int = 10, repo: str | None = None,
    langs: Sequence[str] | None = None, path_glob: str | None = None, broadcast: bool = True,
) -> DataFrame:
    """What ``search_stored`` finds for each of the queries (query_id, query, threshold), which share the limit and the filters.

    Adds query_id; results aren't in order but have their rank. Blocks of queries, which are broadcast,
    meet blocks of rows, so all vectors are read once. ``broadcast``: whether the results may be, too.
    """
    wanted, small = _filter(repo, langs, path_glob), F.broadcast if broadcast else lambda rows: rows
    embeddings, asked = embeddings.filter("embedding IS NOT NULL"), F.broadcast(_query_blocks(queries))
    named = ["repo", "file_path", "line_start", "id"]
    if wanted is None:
        found = _met(_row_blocks(embeddings), asked, limit, lambda ids, at, distance: (ids, distance))
        nearest = Window.partitionBy("query_id").orderBy("_distance", "id")
        found = places.join(small(found.withColumn("_nearest", F.row_number().over(nearest)).filter(F.col("_nearest") <= limit)), "id")
    else:  # in the blocks, rows lie in the order that decides between equal scores
        places = places.filter(wanted)
        rows = places.select(*named).join(embeddings, "id").sortWithinPartitions(*named)

        def best(ids: np.ndarray, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
            score = np.maximum(0.0, 1 - distance / 2)
            return at, np.where(np.isnan(score), -np.inf, -score)

        found = places.join(_met(_row_blocks(rows), asked, limit, best, clamped=True), "id")
    found = found.withColumn("score", vectors.score(F.col("_distance")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *named)
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    found = found.join(F.broadcast(queries.select("query_id", "threshold")), "query_id").filter(F.col("score") >= F.col("threshold"))
    return texts.join(small(found), "id").select("query_id", "rank", "repo", F.col("file_path").alias("path"), F.col("line_start").alias("line"), "score", F.col("content").alias("snippet"), F.coalesce("lang", F.lit("")).alias("lang"))
