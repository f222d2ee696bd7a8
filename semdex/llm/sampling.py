"""Bounded samples for fitting: rows chosen by a hash of their id, alike in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 40


def place(doc_id: str, salt: str) -> Column:
    """A number in [0, 2**40) that depends on the id and ``salt`` alone."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(salt)), F.lit(_STEPS))


def up_to(rows: DataFrame, group: str, most: int, salt: str, doc_id: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each group, or all of a smaller one: those of the lowest places.

    Rows without an id have no place and aren't chosen.

    ``rows`` should be slim: it is read twice. The groups' counts go to the driver, so there should
    be few groups (languages, labels).
    """
    rows = rows.filter(F.col(doc_id).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count(F.lit(1))).collect()}
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen |= F.col(group).eqNullSafe(F.lit(value)) & (place(doc_id, salt) < int(_STEPS * min(1.0, most / n)))
    return rows.filter(chosen)
