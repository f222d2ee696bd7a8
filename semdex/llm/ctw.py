"""Language-model scores by context-tree weighting over bytes, beside a smoothed unigram score.

A byte is eight binary decisions, each with a context tree of its own over the bytes before it, up
to ``depth`` of them. Every node holds a Krichevsky-Trofimov estimate; a node's weighted probability
is half its own estimate's and half the product of its children's, so all depths are mixed. A text is
scored with its end, a zero byte, given zero bytes before it.

The top of the trees, to two bytes of context, is fixed by counts of three bytes in a row over all
training texts, of which there are at most 2**24 whatever the corpus; so counts and tables of it have
a hard bound, and go to every task that needs them. What is deeper grows with the corpus and is never
in one place: each task sends the distinct runs of bytes of some megabytes of text, with their
training counts, to the owners of their three-byte contexts' hashes, who follow the size of the
corpus. An owner has whole trees below such contexts. It first sends out the counts of three bytes in
a row and the weighted probabilities that the top needs, summed by two-byte context; then it answers
each run with the log probability of its last byte.

For the unigram score, the corpus's words are counted. Each task sends the distinct words of a few
megabytes of text to the owners of their hash range, which sum up and answer; what is shuffled
follows the corpus, and no task or driver holds the whole vocabulary. A word is known by a 64-bit
hash.

Defined results: null texts are empty, with the end as their only token; without training texts the
model gives every bit 1/2 and no token is known; equal rows get equal scores; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, distinct, flat, materialize, mix, remainder, spans, stream, word_hashes
from .groups import complete_groups

#: Bytes of context at the top of the trees, and in all if none are asked for; runs are held in 64 bits.
DEPTH, MOST_DEPTH = 2, 7
#: Text bytes and texts that a worker looks at together; text bytes whose distinct words and runs it asks for together.
TEXT_BYTES, _ROWS, CHUNK_TEXT = 1 << 20, 1 << 16, 6 << 20
#: Words are dealt to as many owners as there are shuffle partitions, or more: one for so many bytes of all texts.
_OWNERS, OWNED_TEXT = "spark.sql.shuffle.partitions", 1 << 24
#: Owners of runs of bytes for each of those, so that each has little at a time.
RUN_OWNERS = 4


def codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three bytes in a row as a number, at each byte and end of each text, and where each text's begin."""
    n = len(off) - 1
    begin = off[:-1] + np.arange(n)
    ext = np.zeros(len(buf) + n, np.uint32)
    keep = np.ones(len(ext), bool)
    keep[off[1:] + np.arange(n)] = False
    ext[keep] = buf
    one, two = np.zeros_like(ext), np.zeros_like(ext)
    one[1:] = ext[:-1]
    one[begin] = 0
    two[1:] = one[:-1]
    two[begin] = 0
    return (two << np.uint32(16)) | (one << np.uint32(8)) | ext, begin


def byte_runs(buf: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``codes``, of ``depth`` + 1 bytes in a row."""
    n = len(off) - 1
    begin = off[:-1] + np.arange(n)
    ext = np.zeros(len(buf) + n, np.uint64)
    keep = np.ones(len(ext), bool)
    keep[off[1:] + np.arange(n)] = False
    ext[keep] = buf
    out, before = ext.copy(), ext
    for d in range(1, depth + 1):
        before = np.concatenate([np.zeros(min(1, len(before)), np.uint64), before[:-1]])
        before[begin] = 0
        out |= before << np.uint64(8 * d)
    return out, begin


def _owned(code: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order of their owners, and where each owner's begin (one entry more)."""
    owner = ((mix((code >> np.uint64(8)) & np.uint64(0xFFFFFF)) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(owners + 1))


def _summed(counts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their sums."""
    if len(counts) == 1:
        return counts[0]
    code, at = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in counts]), len(code)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in chunks(batch, limit=TEXT_BYTES):
                buf, off = flat(part.column("text"))
                held.append(np.unique(codes(LOWER[buf], off)[0], return_counts=True))
                if sum(len(c) for c, _ in held) > 1 << 20:
                    held = [_summed(held)]
        if held:
            found, n = _summed(held)
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)].astype(np.int32)), pa.array(n[at : at + (1 << 16)])], ["code", "n"])

    return stream(docs.select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


_SMALL = 32
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))]) + 0.5 * np.log(np.pi)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2 or n + 1 for whole n."""
    x = n + (0.5 if half else 1.0)
    big = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < _SMALL, (_HALVES if half else _WHOLES)[np.minimum(n, _SMALL - 1).astype(np.int64)], big)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False) - np.log(np.pi)


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the 255 decisions (heap order, most significant bit first) from byte counts (..., 256)."""
    zeros, ones, level = [], [], counts
    while level.shape[-1] > 1:
        zeros.append(level[..., 0::2])
        ones.append(level[..., 1::2])
        level = zeros[-1] + ones[-1]
    return np.concatenate(zeros[::-1], -1), np.concatenate(ones[::-1], -1)


_BYTES = np.arange(256)
_PATH = np.stack([(1 << level) - 1 + (_BYTES >> (8 - level)) for level in range(8)])
_BIT = np.stack([(_BYTES >> (7 - level)) & 1 for level in range(8)])


def _byte_log10(ones: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from the chance of a 1 at each decision (..., 255)."""
    both = np.stack([np.log10(1 - ones), np.log10(ones)])
    return sum(both[_BIT[i], ..., _PATH[i]] for i in range(8)).T


def _stay(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted probability's logarithm, and the share of it that is the node's own estimate."""
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def _chance(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def deep(code: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The trees below three bytes of context, for each of a byte's eight decisions.

    From sorted distinct runs of ``depth`` + 1 bytes, all of a three-byte context's among them, and
    their counts: (two-byte context, node) as a number and the logarithm of the weighted probability
    for each node at three bytes; the node and the chance of a 1 there for each run.
    """
    runs, counts, up = [code], [n.astype(np.float64)], []
    for d in range(depth - 1, DEPTH, -1):
        shorter, at = np.unique(runs[-1] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        up.append(at)
        runs.append(shorter)
        counts.append(np.bincount(at, counts[-1], len(shorter)))
    for level in range(8):
        chance, below, place = np.zeros(0), np.zeros(0), np.arange(len(code))
        for i, (run, count) in enumerate(zip(runs, counts, strict=True)):
            prefix = run >> np.uint64(8 - level)
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            group = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]]))
            one = ((run >> np.uint64(7 - level)) & np.uint64(1)).astype(np.float64)
            total, ones = np.add.reduceat(count, first), np.add.reduceat(count * one, first)
            own = kt(total - ones, ones)
            estimate = _chance(total - ones, ones)
            if i == 0:
                weighted, chance = own, estimate[group]
            else:
                place = up[i - 1][place]
                weighted, share = _stay(own, np.bincount(group[up[i - 1][was]], below, len(first)))
                at = group[place]
                chance = share[at] * estimate[at] + (1 - share[at]) * chance
            below, was = weighted, first
        node = lambda x: (1 << level) - 1 + ((x & np.uint64(255)) >> np.uint64(8 - level)).astype(np.int64)  # noqa: B023, E731
        yield (((runs[-1][first] >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) << 8) | node(runs[-1][first]), below, node(code), chance


class Top:
    """The trees to two bytes of context, over deeper ones whose weighted probabilities are given.

    The chance of a 1 at a node is ``base[row[context], node] + rest[row[context], node]`` times the
    deeper tree's.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, key: np.ndarray, below: np.ndarray):
        code, n = code.astype(np.int64), n.astype(np.float64)
        deeper = np.zeros((1 << 16, 255)) if len(key) > 1 << 20 else None
        if deeper is not None:
            deeper[key >> 8, key & 255] = below
        order = np.argsort(key)
        key, below = key[order], below[order]
        last, byte = (code >> 8) & 255, code & 255
        of_one = np.zeros((256, 256))
        np.add.at(of_one, (last, byte), n)
        weighted, share = np.zeros((256, 255)), np.full((256, 255), 0.5)
        second: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for a in np.unique(last):
            m = last == a
            seen, at = np.unique(code[m] >> 16, return_inverse=True)
            counts = np.zeros((len(seen), 256))
            counts[at, byte[m]] = n[m]
            z, o = _nodes(counts)
            if deeper is None:
                want = ((seen << 8 | a)[:, None] << 8) | np.arange(255)
                near = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
                under = np.where(key[near] == want, below[near], 0.0) if len(key) else np.zeros(want.shape)
            else:
                under = deeper[seen << 8 | a]
            both, own = _stay(kt(z, o), under)
            second[int(a)] = (seen, own, _chance(z, o))
            weighted[a], share[a] = _stay(kt(*_nodes(of_one[a])), both.sum(0))
        z0, o0 = _nodes(of_one.sum(0))
        _, top = _stay(kt(z0, o0), weighted.sum(0))
        root = top * _chance(z0, o0)
        self.row = np.zeros(1 << 16, np.int32)
        base, rest = [(root + (1 - top) * 0.375)[None]], [((1 - top) * 0.25)[None]]
        size = 1
        for a, (seen, own, estimate) in second.items():
            own = np.concatenate([np.full((1, 255), 0.5), own])
            estimate = np.concatenate([np.full((1, 255), 0.5), estimate])
            base.append(root + (1 - top) * (share[a] * _chance(*_nodes(of_one[a])) + (1 - share[a]) * own * estimate))
            rest.append((1 - top) * (1 - share[a]) * (1 - own))
            self.row[np.arange(256) << 8 | a] = size
            self.row[seen << 8 | a] = size + 1 + np.arange(len(seen))
            size += 1 + len(seen)
        self.base, self.rest = np.concatenate(base), np.concatenate(rest)

    def log10(self, code: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each run's last byte; the runs as in ``deep``."""
        row = self.row[(code >> np.uint64(8)) & np.uint64(0xFFFF)]
        out = np.zeros(len(code))
        for level, (_, _, node, chance) in enumerate(deep(code, n, depth)):
            one = self.base[row, node] + self.rest[row, node] * chance
            out += np.log10(np.where((code >> np.uint64(7 - level)) & np.uint64(1), one, 1 - one))
        return out


class Model:
    """``table[row[context], byte]``: log10 of the byte's probability after the two bytes before it."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code, kind="stable")
        code, n = code[order].astype(np.int64), n[order].astype(np.float64)
        last, byte = (code >> 8) & 255, code & 255
        of_one = np.zeros((256, 256))
        np.add.at(of_one, (last, byte), n)
        chance = lambda z, o: (o + 0.5) / (z + o + 1)

        def stay(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The weighted probability's logarithm, and the share of it that is the node's own estimate."""
            both = np.logaddexp(own, below) - np.log(2)
            return both, np.exp(own - np.log(2) - both)

        weighted = np.zeros((256, 255))
        share = np.full((256, 255), 0.5)
        deepest: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a in np.unique(last):
            m = last == a
            seen, at = np.unique(code[m] >> 16, return_inverse=True)
            counts = np.zeros((len(seen), 256))
            counts[at, byte[m]] = n[m]
            z, o = _nodes(counts)
            deepest[int(a)] = (seen, chance(z, o))
            weighted[a], share[a] = stay(kt(*_nodes(of_one[a])), kt(z, o).sum(0))
        z0, o0 = _nodes(of_one.sum(0))
        _, top = stay(kt(z0, o0), weighted.sum(0))
        root = top * chance(z0, o0)
        self.row = np.zeros(1 << 16, np.int32)
        rows = [_byte_log10(root + (1 - top) * 0.5)[None]]
        size = 1
        for a, (seen, deep) in deepest.items():
            middle = share[a] * chance(*_nodes(of_one[a]))
            unseen = root + (1 - top) * (middle + (1 - share[a]) * 0.5)
            rows.append(_byte_log10(np.concatenate([unseen[None], root + (1 - top) * (middle + (1 - share[a]) * deep)])))
            self.row[np.arange(256) << 8 | a] = size
            self.row[seen << 8 | a] = size + 1 + np.arange(len(seen))
            size += 1 + len(seen)
        self.table = np.concatenate(rows).ravel()

    def score(self, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros(0)
        return np.add.reduceat(self.table[(self.row[code >> np.uint32(8)].astype(np.int64) << 8) | (code & np.uint32(255))], begin)


def train(training: DataFrame) -> Model:
    got = trigram_counts(training).toArrow()  # 2**24 rows at most
    return Model(np.asarray(got.column("code").combine_chunks()), np.asarray(got.column("n").combine_chunks()))


_ASKED = "array<struct<owner int, n int, values binary, trained binary>>"
_CHUNK = f"chunk long, doc_id array<long>, held_out array<boolean>, sizes array<long>, texts binary, words {_ASKED}, runs {_ASKED}"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _packed(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, all lowest ones first, compressed."""
    return _codec().compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_codec().decompress(data, n * width, asbytes=True), np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _counted(values: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs where nothing is held out."""
    trained = np.sort(values[~held])
    first = np.flatnonzero(np.concatenate([[True], trained[1:] != trained[:-1]])) if len(trained) else np.zeros(0, np.int64)
    n, trained, other = np.diff(np.append(first, len(trained))), trained[first], distinct(values[held])
    if len(trained):
        other = other[trained[np.minimum(np.searchsorted(trained, other), len(trained) - 1)] != other]
    both = np.sort(np.concatenate([trained, other]))
    counts = np.zeros(len(both), np.int64)
    counts[np.searchsorted(both, trained)] = n
    return both, counts


def _words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    starts, ends, first = spans(buf, off)
    return word_hashes(buf, starts, ends), np.diff(first)


def _word_owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _asked(docs: DataFrame, depth: int, owners: int) -> DataFrame:
    """A row for each few megabytes of text: the lower-cased texts, and their distinct words and runs by owner."""

    def by_owner(values: np.ndarray, counts: np.ndarray, cut: np.ndarray, width: int) -> list[dict]:
        return [{"owner": i, "n": b - a, "values": _packed(values[a:b], width), "trained": _packed(counts[a:b], 4)} for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]

    def row(at: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, held, sizes, texts, words, runs = zip(*parts, strict=True)
        words, counts = _summed(words)
        asked = by_owner(words, counts, np.searchsorted(_word_owner(words, owners), np.arange(owners + 1)), 8)
        grams = []
        if depth > DEPTH:
            runs, counts = _summed(runs)
            order, cut = _owned(runs, owners * RUN_OWNERS)
            grams = by_owner(runs[order], counts[order], cut, depth + 1)
        out = {"chunk": at, "doc_id": [x for part in ids for x in part], "held_out": np.concatenate(held).tolist(), "sizes": np.concatenate(sizes).tolist(), "texts": _codec().compress(b"".join(texts), asbytes=True), "words": asked, "runs": grams}
        return pa.RecordBatch.from_pylist([out], _arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in chunks(batch, limit=TEXT_BYTES, rows=_ROWS):
                buf, off = flat(part.column("text"))
                buf = LOWER[buf]
                held = np.asarray(part.column("held_out"))
                hashes, n = _words_of(buf, off)
                words, runs = _counted(hashes, np.repeat(held, n)), None
                if depth > DEPTH:
                    code, begin = byte_runs(buf, off, depth)
                    runs = _counted(code, np.repeat(held, np.diff(np.append(begin, len(code)))))
                parts.append((part.column("doc_id").to_pylist(), held, np.diff(off), buf.tobytes(), words, runs))
                size += len(buf)
                if size >= CHUNK_TEXT:
                    yield row(at, parts)
                    at, parts, size = at + 1, [], 0
        if parts:
            yield row(at, parts)

    asked = pa.list_(pa.struct([("owner", pa.int32()), ("n", pa.int32()), ("values", pa.binary()), ("trained", pa.binary())]))
    _arrow = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("words", asked), ("runs", asked)])
    return stream(docs, run, _CHUNK)


def _dealt(asked: DataFrame, column: str, owners: int) -> DataFrame:
    """(chunk, owner, n, values, trained) of all chunks, an owner's rows together."""
    return asked.select("chunk", F.inline(column)).repartition(owners, "owner").sortWithinPartitions("owner")


def _owned_values(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each owner: chunks, owners and lengths of its rows, its distinct values and their counts, and the rows' places in them."""
    for table, starts in complete_groups(batches, "owner", 1):
        chunk, owner, n = (np.asarray(table.column(c)) for c in ("chunk", "owner", "n"))
        values, trained = table.column("values").to_pylist(), table.column("trained").to_pylist()
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            seen, at = np.unique(np.concatenate([_unpacked(values[i], n[i], width) for i in range(s, e)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([_unpacked(trained[i], n[i], 4) for i in range(s, e)]), len(seen))
            yield chunk[s:e], owner[s:e], n[s:e], seen, counts, at


def _below(rows: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Three bytes in a row and their counts; the logarithms of weighted probabilities at three bytes of context, summed by two-byte context and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, seen, n, _ in _owned_values(batches, depth + 1):
            some = n > 0  # runs of held out texts alone aren't in the trees
            if not some.any():
                continue
            code, at = np.unique(seen[some] & np.uint64(0xFFFFFF), return_inverse=True)
            for deeper, key, value in ((False, code.astype(np.int64), np.bincount(at, n[some])), *((True, key, weighted) for key, weighted, _, _ in deep(seen, n, depth))):
                keys, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), deeper)), pa.array(keys), pa.array(np.bincount(at, value))], ["deeper", "key", "value"])

    got = stream(rows, run, "deeper boolean, key long, value double").groupBy("deeper", "key").agg(F.sum("value").alias("value")).toArrow()  # 256 ** 3 + 255 * 256 ** 2 rows at most
    deeper, key, value = (np.asarray(got.column(c).combine_chunks()) for c in ("deeper", "key", "value"))
    return key[~deeper], value[~deeper], key[deeper], value[deeper]


def _run_logs(rows: DataFrame, top: Top, depth: int) -> DataFrame:
    """(chunk, logs): log10 of the probabilities of the runs asked for, by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, owner, sizes, seen, n, at in _owned_values(batches, depth + 1):
            logs = np.split(top.log10(seen, n, depth)[at], np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(owner), pa.array([x.tobytes() for x in logs], pa.binary())], ["chunk", "owner", "logs"])

    answers = stream(rows, run, "chunk long, owner int, logs binary")
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("owner", "logs")).alias("logs"))  # the runs of one chunk of text


def _answered(rows: DataFrame) -> DataFrame:
    """(chunk, owner, counts, words, tokens): training counts of the words asked for; words and tokens once for each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, owner, sizes, _, n, at in _owned_values(batches, 8):
            counts = [_packed(x, 6) for x in np.split(n[at], np.cumsum(sizes)[:-1])]
            once = np.arange(len(chunk)) == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk), pa.array(owner), pa.array(sizes), pa.array(counts, pa.binary()), pa.array(once * int((n > 0).sum())), pa.array(once * int(n.sum()))],
                ["chunk", "owner", "n", "counts", "words", "tokens"],
            )

    return stream(rows, run, "chunk long, owner int, n int, counts binary, words long, tokens long")


def _score_of_runs(buf: np.ndarray, off: np.ndarray, runs: np.ndarray, logs: np.ndarray, depth: int) -> np.ndarray:
    """Each text's sum of the logarithms of its runs, from all distinct runs in order and theirs."""
    code, begin = byte_runs(buf, off, depth)
    n = len(off) - 1
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(np.append(begin, len(code))))
    if depth <= 5 and n <= _ROWS:  # in order of run, which a sort of 64 bits gives, look-ups are far cheaper
        both = np.sort((code << np.uint64(16)) | text)
        code, text = both >> np.uint64(16), both & np.uint64(0xFFFF)
    return np.bincount(text.astype(np.int64), logs[np.searchsorted(runs, code)], n)


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """The first text of each ``TEXT_BYTES`` or ``_ROWS``, and the one after its last."""
    at, n = 0, len(off) - 1
    while at < n:
        to = min(at + _ROWS, max(at + 1, int(np.searchsorted(off, off[at] + TEXT_BYTES, "right")) - 1))
        yield at, to
        at = to


def _base(buf: np.ndarray, off: np.ndarray, got: list[dict], ends: int, tokens: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words, known tokens and unigram score, from the training counts of all distinct words."""
    parts = [_words_of(buf[off[at] : off[to]], off[at : to + 1] - off[at]) for at, to in _pieces(off)]
    hashes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    place = np.searchsorted(distinct(hashes), hashes)
    counts = np.concatenate([np.zeros(0, np.uint64), *[_unpacked(x["counts"], x["n"], 6) for x in sorted(got, key=lambda x: x["owner"])]])
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    base, known = np.full(len(n), np.log10(ends + 1)), np.full(len(n), int(ends > 0))
    some = n > 0
    if some.any():
        base[some] += np.add.reduceat(np.log10(counts + 1.0)[place], first[some])
        known[some] += np.add.reduceat((counts > 0)[place], first[some], dtype=np.int64)
    return n, known, base - (n + 1) * np.log10(float(tokens + words + 1))


def _scored(chunk: pa.RecordBatch, depth: int, model: Model | None, ends: int, tokens: int, words: int) -> pa.RecordBatch:
    """The scores of a chunk's texts; their bytes are looked at a megabyte at a time, if no text is longer."""
    row = chunk.to_pylist()[0]
    off = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
    buf = np.frombuffer(_codec().decompress(row.pop("texts"), int(off[-1]), asbytes=True), np.uint8)
    n, known, base = _base(buf, off, row.pop("got") or [], ends, tokens, words)
    if depth > DEPTH:
        runs = np.concatenate([_unpacked(x["values"], x["n"], depth + 1) for x in sorted(row.pop("runs"), key=lambda x: x["owner"])])
        logs = np.frombuffer(b"".join(x["logs"] for x in sorted(row.pop("logs"), key=lambda x: x["owner"])))
        order = np.argsort(runs)
        runs, logs = runs[order], logs[order]
    score = []
    for at, to in _pieces(off):
        part, ends_at = buf[off[at] : off[to]], off[at : to + 1] - off[at]
        score.append(_score_of_runs(part, ends_at, runs, logs, depth) if depth > DEPTH else model.score(*codes(part, ends_at)))
    return pa.RecordBatch.from_arrays(
        [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(np.concatenate(score))],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not DEPTH <= depth <= MOST_DEPTH:
        raise ValueError(f"depth is {depth}, not {DEPTH} to {MOST_DEPTH}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    texts, size = docs.agg(F.coalesce(F.count_if(~F.col("held_out")), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    owners = max(1, int(docs.sparkSession.conf.get(_OWNERS)), -(-size // OWNED_TEXT))
    asked = materialize(_asked(docs, depth, owners), "asked")
    answers = materialize(_answered(_dealt(asked, "words", owners)), "answers")
    sums = answers.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    tokens, words, ends = sums[1] + texts, sums[0] + bool(texts), texts

    rows = asked.select("chunk", "doc_id", "held_out", "sizes", "texts", F.transform("runs", lambda x: F.struct(x["owner"].alias("owner"), x["n"].alias("n"), x["values"].alias("values"))).alias("runs"))
    if depth > DEPTH:
        dealt = _dealt(asked, "runs", owners * RUN_OWNERS)
        model = Top(*_below(dealt, depth))
        rows = rows.join(_run_logs(dealt, model, depth), "chunk")
    else:
        model = train(docs.filter("NOT held_out"))

    top_only = None if depth > DEPTH else model  # deeper scores come with the rows, so no task needs the tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scored(batch.slice(i, 1), depth, top_only, ends, tokens, words)

    got = answers.groupBy("chunk").agg(F.collect_list(F.struct("owner", "n", "counts")).alias("got"))  # the words of one chunk of text
    rows = rows.join(got, "chunk", "left")
    return stream(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(of: int = 7, rest: int = 2) -> Column:
    return remainder("doc_id", of) == rest
