"""Banded SimHash signatures and the candidates they give."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .blocks import dealt, groups, meeting


class SimHash:
    """Sign bits against random hyperplanes, ``num_bands`` bands of ``band_width`` bits each.

    A bit is 1 where the projection is not negative; a band's bits fill whole bytes from the high
    end. The planes follow from the seed, or are given.
    """

    def __init__(self, num_bands: int = 12, band_width: int = 6, dim: int = 384, seed: int = 42, planes: np.ndarray | None = None):
        self.num_bands, self.band_width, self.dim = num_bands, band_width, dim
        if planes is None:
            planes = np.random.default_rng(seed).standard_normal((num_bands * band_width, dim), dtype=np.float32)
        self.planes = np.asarray(planes, np.float32)
        if self.planes.shape != (num_bands * band_width, dim):
            raise ValueError(f"planes are {self.planes.shape}, not {(num_bands * band_width, dim)}")

    def bits(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        if x.size == 0:
            return np.zeros((0, self.num_bands, self.band_width), bool)
        if x.ndim != 2 or x.shape[1] != self.dim:
            raise ValueError(f"vectors are {x.shape}, not (n, {self.dim})")
        return (x @ self.planes.T >= 0).reshape(len(x), self.num_bands, self.band_width)

    def bands(self, x: np.ndarray) -> np.ndarray:
        """(vectors, bands, bytes) of packed bits."""
        return np.packbits(self.bits(x), axis=2)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.save(out, self.planes, allow_pickle=False)
        return out.getvalue()

    @staticmethod
    def planes_from(blob: bytes) -> np.ndarray:
        return np.load(io.BytesIO(blob), allow_pickle=False)

    def sign(self, vectors: DataFrame, id_column: str = "chunk_id") -> DataFrame:
        """(id, bands): an array of one byte string for each band, a row per vector."""
        lsh = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                widths = np.diff(np.asarray(batch.column("embedding").offsets))
                if (widths != lsh.dim).any():
                    raise ValueError(f"a vector's width isn't {lsh.dim}")
                x = np.asarray(batch.column("embedding").flatten(), np.float32).reshape(-1, lsh.dim)
                packed = [[b.tobytes() for b in v] for v in lsh.bands(x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.list_(pa.binary()))], [id_column, "bands"])

        return vectors.select(F.col(id_column).cast("long").alias(id_column), "embedding").mapInArrow(run, f"{id_column} long, bands array<binary>")


def exploded(signed: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(id, band_idx, band_hash)."""
    return signed.select(id_column, F.posexplode("bands").alias("band_idx", "band_hash"))


def candidates(signed: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """Pairs (id_a < id_b) that share a band, each once.

    A pair is kept in the first band that it shares only, so no distinct is needed afterwards.
    """
    rows = signed.select(F.col(id_column).alias("id"), "bands", F.posexplode("bands").alias("band", "hash"))
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "bands", "band", "hash")]) for s in "ab")
    pairs = a.join(b, (F.col("band_a") == F.col("band_b")) & (F.col("hash_a") == F.col("hash_b")) & (F.col("id_a") < F.col("id_b")))
    earlier = F.exists(F.sequence(F.lit(0), F.col("band_a")), lambda i: (i < F.col("band_a")) & (F.get("bands_a", i) == F.get("bands_b", i)))
    return pairs.filter(~earlier).select("id_a", "id_b")


#: Vectors of a bucket that a task holds of one part, about; and of a part of all vectors, which is sent once for each part.
PART, WHOLE_PART = 1024, 32768
#: Rows and columns of a block of cosines that are looked at together.
BLOCK_ROWS, BLOCK_COLUMNS = 512, 4096


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length in double precision; zero vectors stay."""
    x = np.asarray(vectors.combine_chunks().flatten(), np.float64).reshape(len(vectors), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def similar(signed: DataFrame, vectors: DataFrame, threshold: float, id_column: str = "chunk_id") -> DataFrame:
    """(id_a, id_b, similarity) of the pairs that share a band and whose cosine is at least ``threshold``.

    A bucket's members meet in blocks, in numpy, so a vector is sent once for each bucket, not for each
    pair, and pairs below the threshold are never rows. As in ``candidates``, a pair counts in the first
    band that it shares. A zero vector has the cosine 0.
    """
    bucket = F.xxhash64("band", "hash")
    rows = signed.select(F.col(id_column).alias("id"), "bands", F.posexplode("bands").alias("band", "hash")).withColumn("bucket", bucket).drop("hash")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("bucket", "_bucket")
    rows = rows.join(sizes, F.col("bucket") == F.col("_bucket")).join(vectors.select(F.col(id_column).alias("id"), "embedding"), "id")
    tasks = dealt(rows, F.ceil(F.col("_n") / PART), "bucket", "id").select("task", "side", "id", "band", "bands", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in groups(batches, "task"):
            if task.num_rows < 2:
                continue
            ids, side, band = (np.asarray(task.column(c)) for c in ("id", "side", "band"))
            x = _unit(task.column("embedding"))
            like = x @ x.T
            met = meeting(side) & (like >= threshold)
            hashes = np.array(task.column("bands").to_pylist(), object)[:, : band[0] + 1]
            for i in range(band[0] + 1):  # two buckets of one hash aside, all agree in the last of these
                same = np.unique(hashes[:, i].astype("S"), return_inverse=True)[1] if len(ids) else band
                met &= (same[:, None] == same[None, :]) if i == band[0] else (same[:, None] != same[None, :])
            a, b = np.nonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(like[a, b])], ["id_a", "id_b", "similarity"])

    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "id_a long, id_b long, similarity double")


def alike(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, cosine): rows of ``x`` and of ``y`` at or above ``threshold``, some at a time; without ``y``, pairs a < b of ``x``.

    Cosines are found in single precision and those near or above the threshold again in double.
    """
    single = x.astype(np.float32)
    other, others = (x, single) if y is None else (y, y.astype(np.float32))
    width = min(BLOCK_COLUMNS, -(-len(other) // 8) * 8)
    for top in range(0, len(x), BLOCK_ROWS):
        rows = single[top : top + BLOCK_ROWS]
        near = np.zeros((len(rows), width), bool)  # its width is a multiple of 8, so eight can be looked at as one
        for left in range(0 if y is not None else top // width * width, len(other), width):
            columns = others[left : left + width]
            near[:, len(columns) :] = False
            np.greater_equal(rows @ columns.T, threshold - 1e-5, out=near[:, : len(columns)])
            eight = np.flatnonzero(near.ravel().view(np.uint64))
            for i in range(0, len(eight), 8192):
                found = (eight[i : i + 8192, None] * 8 + np.arange(8)).ravel()
                found = found[near.ravel()[found]]
                a, b = found // width + top, found % width + left
                if y is None:
                    a, b = a[a < b], b[a < b]
                sims = np.einsum("pd,pd->p", x[a], other[b])
                ok = sims >= threshold
                if ok.any():
                    yield a[ok], b[ok], sims[ok]


def similar_exact(vectors: DataFrame, threshold: float, id_column: str = "chunk_id", part: int = PART, carried: Sequence[str] = ()) -> DataFrame:
    """As ``similar``, of all pairs: what signatures are measured against. The work grows with the square of the rows.

    The columns ``carried`` of both come with a pair, with _a and _b after their names.
    """
    everything = vectors.select(F.col(id_column).cast("long").alias("id"), "embedding", *carried).withColumn("_all", F.lit(0))
    parts = max(1, -(-vectors.count() // part))
    tasks = dealt(everything, F.lit(parts), "_all", "id").select("task", "side", "id", "embedding", *carried)
    kinds = {f.name: f.dataType.simpleString() for f in tasks.schema}
    names = [f"{c}_{s}" for s in "ab" for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in groups(batches, "task"):
            side = np.asarray(task.column("side"))
            own, other = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
            x = _unit(task.column("embedding"))
            task = task.select(["id", *carried]).combine_chunks()
            ids = np.asarray(task.column("id"))
            within = side.size and side[0] == 2
            for a, b, sims in alike(x if within else x[own], None if within else x[other], threshold):
                a, b = own[a], other[b]
                a, b = np.where(ids[a] <= ids[b], a, b), np.where(ids[a] <= ids[b], b, a)
                both = [task.column(c).take(pa.array(rows)).combine_chunks() for rows in (a, b) for c in carried]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sims), *both], ["id_a", "id_b", "similarity", *names])

    schema = ", ".join(["id_a long, id_b long, similarity double", *(f"{c}_{s} {kinds[c]}" for s in "ab" for c in carried)])
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, schema)


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float, id_column: str = "chunk_id") -> DataFrame:
    """(id_a, id_b, similarity) of pairs whose cosine is at least ``threshold``; norms are worked out once a vector."""
    slim = vectors.select(F.col(id_column).alias("_id"), "embedding", V.norm(F.col("embedding")).alias("_norm"))
    a, b = (slim.select(F.col("_id").alias(f"_id_{s}"), F.col("embedding").alias(f"_e_{s}"), F.col("_norm").alias(f"_n_{s}")) for s in "ab")
    rows = pairs.join(a, F.col("id_a") == F.col("_id_a")).join(b, F.col("id_b") == F.col("_id_b"))
    rows = rows.withColumn("similarity", V.cosine(F.col("_e_a"), F.col("_e_b"), F.col("_n_a"), F.col("_n_b")))
    return rows.filter(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity")
