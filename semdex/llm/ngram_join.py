"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A document is the set of its runs of five words, lower-cased in A-Z. Documents of equal sets are one
class, and one of them stands for all. The join over the representatives:

1. Each has 63 MinHash values; those equal in any of 21 runs of three values share a bucket. A pair
   at the threshold misses every bucket with a chance of 3 in 10 million.
2. In a bucket, the values of each pair are compared seven at a time. After n values of which m
   agree, the similarity's posterior (uniform prior) is Beta(m + 1, n - m + 1); a pair whose
   posterior chance of reaching the threshold is below the tolerance is dropped. A task sends out
   links that span the surviving pairs, never all of them.
3. Components of these links are families. Within a family, surviving pairs are verified exactly on
   the sets, and each document counts its verified links.

Buckets and families of any size are dealt out as blocks: a group is hashed to parts of about
``PART`` documents, and each pair of parts is a task. So no task's input grows with a group, no pair
is left out, and tasks return a row for each document they hold.

Defined results: null texts, and texts without a word, link with nothing; a text of one to four words
is a set of one run; equal rows link with each other; rows with a null id are left as they are; rows
that repeat an id with another text count as one more document under that id, in the same class; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import dealt
from .common import LOWER, chunks, distinct, flat, materialize, mix, spans, stream, word_hashes
from .graph import components
from .groups import complete_groups

RUN = 5
THRESHOLD = Fraction(4, 5)
TOLERANCE = 1e-6
BANDS, ROWS = 21, 3
HASHES = BANDS * ROWS
STEP = 7  # values compared at a time; divides HASHES
#: Documents, and runs of words, that a part of a large group holds, about.
PART, PART_RUNS = 1024, 1_000_000
#: Ids that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, RUN, np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0..HASHES compared values, the least m that keeps a pair.

    P(s >= t) under Beta(m + 1, n - m + 1) is the chance of at most m successes in n + 1 trials.
    """
    t, out = float(threshold), np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words, with repeats, and where each text's begin (one entry more)."""
    buf, off = flat(texts)
    buf = LOWER[buf]
    starts, ends, first = spans(buf, off)
    words = word_hashes(buf, starts, ends)
    n = np.diff(first)
    count = np.where(n >= RUN, n - RUN + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    padded = np.concatenate([words, np.zeros(RUN, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    short = np.repeat(np.where(n < RUN, n, RUN), count)
    for k in range(RUN):
        total += np.where(k < short, padded[at + k] * _PLACES[k], np.uint64(0))
    return mix(total + short.astype(np.uint64)), begin


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values (texts, HASHES); a text without runs has the largest value throughout."""
    n = len(begin) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((values * _FACTORS[k]) >> np.uint64(32), begin[full]).astype(np.uint32)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs (distinct), set_id (16 bytes that name the set), signature, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, begin = runs(part.column("text"))
                sig = signatures(values, begin)
                bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
                keys = mix(bands[:, :, 0] * _PLACES[0] + bands[:, :, 1] * _PLACES[1] + bands[:, :, 2] * _PLACES[2] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                n, name = [], []
                for i in range(part.num_rows):
                    s = distinct(values[begin[i] : begin[i + 1]])
                    n.append(len(s))
                    name.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0x5BF03635)).sum()], np.uint64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int32()), pa.array(name, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, keys.ravel())],
                    ["doc_id", "n_runs", "set_id", "signature", "buckets"],
                )

    return stream(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_runs int, set_id binary, signature binary, buckets array<long>")


def _pairs(side: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one task, some at a time: all of them, or those across its two parts."""
    own = np.flatnonzero(side == 2)
    left, right = (own, own) if len(own) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, most // max(1, len(right)))
    for at in range(0, len(left), step):
        a, b = np.meshgrid(left[at : at + step], right, indexing="ij")
        a, b = a.ravel(), b.ravel()
        if len(own):
            a, b = a[a < b], b[a < b]
        if len(a):
            yield a, b


def _surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are left when values are compared some at a time and hopeless pairs dropped."""
    matches = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        if not len(a):
            break
        matches += (sig[a, at : at + STEP] == sig[b, at : at + STEP]).sum(1)
        alive = matches >= need[at + STEP]
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is linked with, through others too."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots alone move, so all below them move along
        while (root[root] != root).any():
            root = root[root]
    return root


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` with more links: what is kept between blocks of pairs is a row's root, not the pairs."""
    return _roots(len(root), np.concatenate([a, np.arange(len(root))]), np.concatenate([b, root])) if len(a) else root


def _small_groups(starts: np.ndarray, most: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in groups of up to ``most`` rows, for all groups of a size at once."""
    sizes = np.diff(starts)
    for m in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
        a, b = np.triu_indices(m, 1)
        at = starts[:-1][sizes == m][:, None]
        yield (at + a).ravel(), (at + b).ravel()


def candidate_links(buckets: DataFrame, need: np.ndarray) -> DataFrame:
    """Links (a, b) that span the surviving pairs of each task; rows: task, side, rep, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in complete_groups(batches, "task"):
            rep, side = np.asarray(table.column("rep")), np.asarray(table.column("side"))
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            root = np.arange(len(rep))
            for a, b in _small_groups(starts):
                own = np.isin(side[a] + side[b], (1, 4))  # both of one part's own task, or one of each part
                root = _joined(root, *_surviving(sig, a[own], b[own], need))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 24:
                    own = np.arange(e - s)
                    for a, b in _pairs(side[s:e]):
                        own = _joined(own, *_surviving(sig[s:e], a, b, need))
                    root[s:e] = own + s
            linked = np.flatnonzero(root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], ["a", "b"])

    return stream(buckets.select("task", "side", "rep", "signature").repartition("task").sortWithinPartitions("task"), run, "a long, b long")


def verified(members: DataFrame, need: np.ndarray, threshold: Fraction) -> DataFrame:
    """(rep, links, root) for each task's documents; rows: task, side, rep, copies, runs."""
    up, down = threshold.numerator, threshold.denominator

    def task(side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in sets])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        everything = np.concatenate(sets)
        _, ids = np.unique(everything, return_inverse=True)
        mark = np.zeros(int(ids.max()) + 1, bool)
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        for a, b in _pairs(side):
            a, b = _surviving(sig, a, b, need)
            kept = []
            for i in distinct(a):
                others = b[a == i]
                own = ids[begin[i] : begin[i] + sizes[i]]
                mark[own] = True
                if len(others) * 4 > len(sets):
                    common = np.add.reduceat(mark[ids], begin, dtype=np.int64)[others]
                else:
                    common = np.array([mark[ids[begin[j] : begin[j] + sizes[j]]].sum() for j in others])
                mark[own] = False
                ok = others[common * down >= up * (sizes[i] + sizes[others] - common)]
                links[i] += copies[ok].sum()
                links[ok] += copies[i]
                kept.append((np.full(len(ok), i), ok))
            if kept:
                root = _joined(root, *(np.concatenate(x) for x in zip(*kept, strict=True)))
        return links, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in complete_groups(batches, "task", 512):
            rep, side, copies = (np.asarray(table.column(c)) for c in ("rep", "side", "copies"))
            raw = table.column("runs").to_pylist()
            out = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                rows = s + np.unique(rep[s:e], return_index=True)[1]
                sets = [np.frombuffer(raw[i], np.uint64) for i in rows]
                sig = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
                links, root = task(side[rows], copies[rows], sets, sig)
                out.append((rep[rows], links, rep[rows][root]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "root"])

    return stream(members.select("task", "side", "rep", "copies", "runs").repartition("task").sortWithinPartitions("task"), run, "rep long, links long, root long")


def _with_runs(rows: DataFrame) -> DataFrame:
    """Replace text by runs, the sorted distinct hashes; rows whose set isn't the named one go."""
    kept = [f for f in rows.schema if f.name not in ("text", "set_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, begin = runs(part.column("text"))
                sets = [distinct(values[begin[i] : begin[i + 1]]) for i in range(part.num_rows)]
                same = [np.array([mix(s).sum(), mix(s ^ np.uint64(0x5BF03635)).sum()], np.uint64).tobytes() == x for s, x in zip(sets, part.column("set_id").to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array([s.tobytes() for s in sets], pa.binary())], [*[f.name for f in kept], "runs"])
                yield out.filter(pa.array(same, pa.bool_()))

    return stream(rows, run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "runs binary"]))


def join(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id (the least id that links lead to), n_links (documents linked directly)."""
    need = least_matches(threshold, tolerance)
    sketches = materialize(sketch(docs), "sketches")
    usable = sketches.filter("n_runs > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_runs").alias("n_runs"), F.first("signature").alias("signature"), F.first("buckets").alias("buckets"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # an id may stand for several sets, a number for one

    rows = classes.select("rep", F.explode("buckets").alias("bucket"))
    # sizes are written before they are joined, so that Spark can split a hot bucket or family
    counts = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    rows = rows.join(counts, "bucket").join(classes.select("rep", "signature"), "rep")
    links = candidate_links(dealt(rows, F.ceil(F.col("n") / PART), "bucket", "rep"), need)
    families = components(links)

    members = families.withColumnsRenamed({"node": "rep"}).join(classes.select("rep", "least", "set_id", "copies", "n_runs"), "rep")
    members = materialize(members, "members")
    sizes = members.groupBy(F.col("component").alias("_family")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n_runs") / PART_RUNS)).alias("parts"))
    sizes = materialize(sizes, "families")
    members = members.join(sizes, F.col("component") == F.col("_family")).select("rep", "least", "component", "set_id", "copies", "parts")
    few = members.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), "text").join(F.broadcast(members) if few else members, "least")
    found = materialize(verified(dealt(_with_runs(texts), F.col("parts"), "component", "rep"), need, threshold), "verified")

    ids = classes.select("rep", "least")
    linked_ids = found.select("rep", "root").join(ids, "rep").select("root", F.col("least").alias("a")).join(ids.withColumnsRenamed({"rep": "root", "least": "b"}), "root").select("a", "b")
    again = sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_id").alias("_first"), F.max("set_id").alias("_last")).filter("_first <> _last").select("doc_id")
    again = materialize(again, "again")
    repeats = not again.isEmpty()
    if repeats:  # all sets of an id are of its class
        linked_ids = linked_ids.union(usable.join(again, "doc_id").select(F.col("doc_id").alias("a"), "set_id").join(classes.select("set_id", F.col("least").alias("b")), "set_id").select("a", "b"))
    groups = components(linked_ids).withColumnsRenamed({"node": "least"})
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.select("set_id", "rep", "least", "copies").join(linked, "rep", "left").join(groups, "least", "left")
    result = result.select(F.col("set_id").alias("_set"), F.coalesce("component", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).filter("n_links > 0")
    out = sketches.select("doc_id", "set_id").join(result, F.col("set_id") == F.col("_set"), "left")
    if repeats:
        out = out.join(groups.join(again, F.col("least") == F.col("doc_id")).select(F.col("least").alias("_id"), "component"), F.col("doc_id") == F.col("_id"), "left")
        out = out.withColumn("class_id", F.coalesce("component", "class_id"))
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", mine.alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The documents whose id is their class's least; rows of one id stay or go together."""
    gone = materialize(join(docs, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
