"""Groups of any size in tasks of bounded size: every pair of members meets in exactly one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, parts: Column, group: str, member: str) -> DataFrame:
    """Deal each group's members to tasks: one for each pair of the group's parts, part with itself too.

    Adds task (a hash of group and pair) and side: 0 or 1 in a task of two parts, 2 in one of one.
    """
    rows = rows.withColumn("_parts", parts.cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(member, F.lit("part")), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    side = F.when(F.col("_part") == F.col("_other"), 2).when(F.col("_part") < F.col("_other"), 0).otherwise(1)
    task = F.xxhash64(group, F.least("_part", "_other"), F.greatest("_part", "_other"))
    return rows.withColumns({"side": side.cast("int"), "task": task}).drop("_parts", "_part", "_other")


def meeting(side: np.ndarray) -> np.ndarray:
    """For the rows of one task, which pairs (a before b) meet there, as a matrix."""
    across = side[:, None] != side[None, :]
    return np.triu(across | (side == 2)[:, None], 1)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.asarray(batch.column(key))
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)) if len(keys) else []
        at = 0
        for end in ends:
            if held and keys[at] != held[-1].column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)
