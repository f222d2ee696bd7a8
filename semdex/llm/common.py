"""What the operators share: scratch tables, bounded Arrow streams, global ranks, and words of whole batches."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of words: a word is [^\x20\x09-\x0D]+.
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
#: Text bytes that a Python worker holds at a time, if no single text is longer.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to a Python worker, if no single row is longer, and of a scratch table's row group.
BATCH_BYTES = 4 << 20
ROW_GROUP = 16 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir.

    Only where that is unset and all runs on this machine, as in tests, a local folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        at = spark.sparkContext.getCheckpointDir()
    return str(at).rstrip("/")


def stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow``, with batches of bounded size: by default they hold up to 64 MB on both sides.

    The bound is a setting of the session; one that the session has set itself stays.
    """
    if df.sparkSession.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back, which cuts its lineage.

    The table is written once, by tasks that can be run again, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)  # a task holds a row group until it is written
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def global_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank", total: str | None = None) -> DataFrame:
    """Add each row's rank (from 0) in its group, in the order given; ``total`` gets the group's rows.

    The rows are range-partitioned by group and order, so a group of any size is spread over many
    tasks; ``order`` should end in a unique column. Ranks come from counts for each piece of a group
    in a partition, of which there are at most partitions plus groups. ``df`` is written first, as a
    range partitioning reads its input twice, once for a sample.
    """
    keys = [*group, *order]
    unranked = materialize(df, "unranked")
    put = (
        unranked.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    put = materialize(put, "rank")
    discard(unranked)
    pieces = put.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_part")
    everything = Window.partitionBy(*[F.col(g) for g in group])
    pieces = pieces.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        (F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(everything).alias("_total"),
    )
    same: Column = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    ranked = put.join(pieces, same).withColumn(out, F.col("_at") + F.col("_shift"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_at", "_part", "_p", "_shift", "_total", *[f"_g{i}" for i in range(len(group))])


def remainder(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (null id: of the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(of))


# --- words of Arrow batches, without a loop over documents -----------------------------------

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; numpy's own way of this is many times slower for whole numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.lru_cache(maxsize=1)  # 17 MB for a chunk
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return buf, off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text and ``rows`` rows each, or one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        to = min(to, at + rows)
        yield batch.slice(at, to - at)
        at = to


def spans(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end, and each text's first word (one entry more)."""
    sep = separators[buf]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    if len(buf):
        before[0] = after[-1] = True
        before[1:], after[:-1] = sep[:-1], sep[1:]
        inner = off[(off > 0) & (off < len(buf))]
        before[inner] = True
        after[inner - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(20, int(len(buf) - 1).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
