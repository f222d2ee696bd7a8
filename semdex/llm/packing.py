"""Best-fit packing of documents into sequences of a fixed number of tokens, by local search.

How many pieces there are of each length is all that a packing depends on, and that is at most
``capacity`` numbers however many documents there are. The driver searches on these: bins of like
content are one *class* with a count. From a next-fit packing on, each step of the search exchanges
one document for one, two for one, or moves one, between two classes of underfull bins, in as many
bins at once as both have. Every step adds to the sum of squared fills, as the bin that gains ends
fuller than the other was, until bins run empty; the search ends when no step of any bin does. The
result says which ranks of a length go to which sequences; executors then place each piece by its rank
among the pieces of its length.

Defined results: a null text is an empty document (its end id only); equal rows are packed each for
itself; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, global_rank, materialize, stream

CAPACITY = 1024
END_ID = 2
#: Pieces that one search packs, about; of more, equal parts are packed alike.
AT_ONCE = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids of texts under a byte-level BPE file of the tokenizers library.

    The file's ids are the order of its merges, so another public library that is several times as
    fast gives the same ids from the same file; tests hold the two together.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        special = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        ranks = {bytes(map(letters.__getitem__, k)): v for k, v in read["model"]["vocab"].items() if k not in special}
        self._of = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self._of.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: a longer one is cut so that only its first piece is short."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                ids, piece, start, length, crc = [], [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    body = enc(text.as_py() or "") + end
                    n = len(body) // 4
                    at, k = 0, 0
                    while at < n:
                        to = at + ((n - 1) % capacity + 1 if at == 0 else capacity)
                        ids.append(doc)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(body[4 * at : 4 * to]))
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return stream(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


Bin = tuple[int, ...]


def next_fit(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """The packing that the search begins with: next fit of the longest piece that is left, then the shortest ones.

    All bins that begin with a length take the same piece at once, so the work depends on the lengths.
    """
    left, sizes = dict(counts), sorted(counts)
    bins: Counter[Bin] = Counter()
    low = 0
    for longest in reversed(sizes):
        begun = [((longest,), left.pop(longest))]
        while begun:
            content, n = begun.pop()
            while low < len(sizes) and not left.get(sizes[low]):
                low += 1
            fits = (capacity - sum(content)) // sizes[low] if low < len(sizes) else 0
            if not fits:
                bins[content] += n
                continue
            size = sizes[low]
            full, rest = divmod(min(left[size], n * fits), fits)
            left[size] -= full * fits + rest
            more = [(content, n - full - bool(rest)), (content + (size,) * rest, int(bool(rest))), (content + (size,) * fits, full)]
            begun += [x for x in more if x[1]]
    return +bins


def _sums(b: Bin) -> dict[int, Bin]:
    """What a bin can give, by its length: one document, or else two."""
    held = Counter(b)
    ones = list(held)
    two = {x + y: (x, y) for i, x in enumerate(ones) for y in ones[i:] if x != y or held[x] > 1}
    return two | {x: (x,) for x in ones}


class Search:
    """Local search over classes of bins; see the module's text.

    Bins that are full take no part. The others are found by the room they have, and by the lengths
    that would fill them in exchange for what they can give.
    """

    #: A step that leaves its receiver this much fuller than another counts as better, whatever it moves.
    SLACK = 64

    def __init__(self, bins: Counter[Bin], capacity: int):
        self.capacity = capacity
        self.bins: dict[Bin, int] = {}
        self.by_room: dict[int, dict[Bin, None]] = {}
        self.rooms: list[int] = []  # sorted
        self.fills: dict[int, dict[tuple[Bin, Bin], int]] = {}  # length that fills: (receiver, what it gives), and how long that is
        self.heap: list[tuple[int, Bin]] = []
        for b, n in bins.items():
            self._add(tuple(sorted(b, reverse=True)), n)

    def _add(self, b: Bin, n: int) -> None:
        self.bins[b] = self.bins.get(b, 0) + n
        room = self.capacity - sum(b)
        if self.bins[b] > n or not room:
            return
        if room not in self.by_room:
            self.by_room[room] = {}
            bisect.insort(self.rooms, room)
        self.by_room[room][b] = None
        for length, out in _sums(b).items():
            self.fills.setdefault(length + room, {})[b, out] = length
        heapq.heappush(self.heap, (sum(b), b))

    def _take(self, b: Bin, n: int) -> None:
        self.bins[b] -= n
        if self.bins[b]:
            return
        del self.bins[b]
        room = self.capacity - sum(b)
        del self.by_room[room][b]
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[bisect.bisect_left(self.rooms, room)]
        for length, out in _sums(b).items():
            del self.fills[length + room][b, out]
            if not self.fills[length + room]:
                del self.fills[length + room]

    def _step(self, donor: Bin) -> tuple[Bin, Bin, Bin] | None:
        """The best step for a donor: (receiver, what it gives, what it gets).

        It is a move, or an exchange of one for one, two for one or one for two. The receiver ends
        fuller than the donor was, so the sum of squared fills rises. Receivers that end about as
        full are compared by how much the donor loses.
        """
        fill, alone = sum(donor), self.bins[donor] == 1
        best, step = (self.capacity, 0), None
        for b in dict.fromkeys(donor):
            for room in self.rooms[bisect.bisect_left(self.rooms, b) :][:2]:  # of the tightest, one may be the donor's own
                to = next((to for to in self.by_room[room] if to != donor or not alone), None)
                if to is not None and self.capacity - room + b > fill and ((room - b) // self.SLACK, -b) < best:
                    best, step = ((room - b) // self.SLACK, -b), (to, (), (b,))
        gives = _sums(donor)
        for left in range(self.capacity - fill):
            if left // self.SLACK > best[0]:
                break
            for length, into in gives.items():
                for (to, out), back in self.fills.get(length + left, {}).items():
                    found = (left // self.SLACK, back - length)
                    if back < length and found < best and min(len(out), len(into)) == 1 and (to != donor or not alone):
                        best, step = found, (to, out, into)
        return step

    def run(self, effort: int | None = None) -> Counter[Bin]:
        """Empty the emptiest bins into fuller ones until no step helps, the count is least, or ``effort`` steps are taken."""
        fewest = -(-sum(sum(b) * n for b, n in self.bins.items()) // self.capacity)
        count, steps = sum(self.bins.values()), 0
        while self.heap and count > fewest and steps != effort:
            _, donor = heapq.heappop(self.heap)
            step = self._step(donor) if donor in self.bins else None
            if step is None:
                continue
            to, out, into = step
            n = self.bins[donor] // 2 if to == donor else min(self.bins[to], self.bins[donor])
            gained, lost = Counter(to), Counter(donor)
            gained.subtract(out)
            gained.update(into)
            lost.subtract(into)
            lost.update(out)
            self._take(donor, n)
            self._take(to, n)
            for x in (gained, lost):
                if b := tuple(sorted(x.elements(), reverse=True)):
                    self._add(b, n)
                else:
                    count -= n
            if donor in self.bins:
                heapq.heappush(self.heap, (sum(donor), donor))
            steps += 1
        return Counter(self.bins)


def packed(counts: dict[int, int], capacity: int = CAPACITY, at_once: int = AT_ONCE) -> Counter[Bin]:
    """Bins of all pieces, found by search alone.

    Of more than about ``at_once`` pieces, so many equal parts are made that one part is no larger; it
    is packed once and counts for all of them. What doesn't divide evenly, a small share, is packed
    in the same way. So the driver's work doesn't grow with the corpus.
    """
    bins = Counter({(capacity,): counts[capacity]} if counts.get(capacity) else {})
    rest = {k: n for k, n in counts.items() if n and k < capacity}
    while rest:
        parts = -(-sum(rest.values()) // max(at_once, 4 * capacity))
        one = {k: n // parts for k, n in rest.items() if n >= parts}
        for b, n in Search(next_fit(one, capacity), capacity).run().items():
            bins[b] += n * parts
        rest = {k: n % parts for k, n in rest.items() if n % parts}
    return bins


def plan(counts: dict[int, int], capacity: int = CAPACITY, at_once: int = AT_ONCE) -> list[tuple[int, int, int, int, int, int]]:
    """From pieces by length: (length, first rank, past the last rank, bins, first sequence, offset).

    Piece number r of a length, in the row where first <= r < past, goes to sequence
    first sequence + (r - first) % bins, at offset + (r - first) // bins * length.
    """
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for content, n in sorted(packed(counts, capacity, at_once).items(), reverse=True):
        offset = 0
        for size, times in Counter(content).items():
            rows.append((size, used[size], used[size] + n * times, n, sequence, offset))
            used[size] += n * times
            offset += size * times
        sequence += n
    assert used == Counter(counts)
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, at_once: int = AT_ONCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = global_rank(pieces_of(docs, tokenizer or default_tokenizer(), capacity, end_id), ["length"], ["doc_id", "piece", "ids_crc32"])
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity, at_once)
    names = ["_length", "_first", "_past", "_bins", "_sequence", "_offset"]
    where = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    same = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_past"))
    placed = pieces.join(F.broadcast(where), same)  # some thousand rows, whatever the input: one for each length in each class of bins
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + (F.col("rank") - F.col("_first")) % F.col("_bins")).alias("sequence_id"),
        F.expr("_offset + (rank - _first) div _bins * length").alias("offset"),
    )
