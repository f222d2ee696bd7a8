"""Streams of Arrow batches that are sorted by a key, cut where a group ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def complete_groups(batches: Iterator[pa.RecordBatch], key: str, enough: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, about ``enough`` rows each, and where each group begins (one entry more).

    What is held back is one group, so groups must be of bounded size.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = np.asarray(table.column(key))
        return table, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table, starts = cut(pa.Table.from_batches(held))
        if len(starts) > 2:
            last = int(starts[-2])
            yield table.slice(0, last), starts[:-1]
            held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
    if rows:
        yield cut(pa.Table.from_batches(held))
