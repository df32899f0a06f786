"""Key values that very many rows share, handled apart from all others.

A shuffle brings all rows of one key value to one task. Adaptive execution splits such tasks only
where both sides of a join come straight from a shuffle, not where a side was aggregated first.
So joins to an aggregated side take the few hot values out: their rows stay where they are and
are joined to a side that has at most one row per hot value, which is broadcast if it has few rows.

Hot values are found in a sample, and there are at most as many as rows / ``min_rows``. Which values are found decides how rows are joined, never
which rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions.columns import named
from tableflow.sources.scratch import drop_scratch, written

_COUNT = "__sampled"

#: A side may be broadcast if the optimizer's estimate of its size is no larger.
BROADCAST_BYTES = 16 * 1024 * 1024

#: Hot values are broadcast as long as there are so few of them; with more they are joined by a shuffle.
BROADCAST_VALUES = 10_000


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer puts ``df`` at ``max_bytes`` or less. Nothing is run.

    The estimate of a scan is the size of its files, and filters and aggregations count as their input, so
    a small table that was derived from a large one is not taken for small.
    """
    if max_bytes <= 0:
        return False
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= max_bytes


@dataclass(frozen=True)
class HotKeys:
    """Values with about ``min_rows`` rows or more are hot, found in a sample of the rows."""

    min_rows: int = 1_000_000
    sample_fraction: float = 0.001


def hot_values(
    tables: Sequence[DataFrame], columns: Sequence[str], rule: HotKeys | None
) -> DataFrame | None:
    """The hot values of ``columns`` over all ``tables``, or None where there are none."""
    if rule is None:
        return None
    rows = reduce(DataFrame.unionByName, [t.select(*map(named, columns)) for t in tables])
    if rule.sample_fraction < 1:
        rows = rows.sample(rule.sample_fraction, seed=11)
    # Half the expected number of sampled rows, so that a hot value is hardly ever missed.
    enough = max(rule.min_rows * rule.sample_fraction / 2, 1)
    found = (
        rows.groupBy(*map(named, columns))
        .agg(F.count(F.lit(1)).alias(_COUNT))
        .filter(F.col(_COUNT) >= enough)
        .drop(_COUNT)
    )
    stored, path = written(found, "hot")
    if stored.isEmpty():
        drop_scratch(found.sparkSession, path)
        return None
    return F.broadcast(stored) if stored.count() <= BROADCAST_VALUES else stored


def _same(columns: Sequence[str]) -> list[Column]:
    return [named(c).eqNullSafe(F.col(f"__hot_{i}")) for i, c in enumerate(columns)]


def only_hot(df: DataFrame, columns: Sequence[str], hot: DataFrame) -> DataFrame:
    """Rows with a hot value. Nulls are values here."""
    listed = hot.toDF(*[f"__hot_{i}" for i in range(len(columns))])
    return df.join(listed, _same(columns), "left_semi")


def without_hot(df: DataFrame, columns: Sequence[str], hot: DataFrame) -> DataFrame:
    """Rows without a hot value."""
    listed = hot.toDF(*[f"__hot_{i}" for i in range(len(columns))])
    return df.join(listed, _same(columns), "left_anti")
