"""Joins of points to the ranges that hold them, without comparing every pair of rows.

1. Cut points, about evenly spaced among the points, come from percentiles of a sample and divide the points into bins of about
   ``rows_per_bin`` rows. They are numbers, at most ``max_bins`` of them, and part of the plan.
2. A point lies in one bin; a range is copied to the bins that it overlaps. Bins are joined by equality, so that Spark picks a hash
   or a sort-merge join, and the bounds are checked on what meets in a bin. A range is compared in vain only with points of its
   first and last bin.
3. Where one instant has very many points, no cut point divides them, and where very many ranges overlap, their copies fill a bin.
   Bins with more than ``rows_per_task`` rows of a side are split by row number: that side's rows are dealt to so many shares of the bin,
   and the other side's rows are copied to each of them.

Bin counts are one row per bin. Cut points and shares decide how rows are spread, never which pairs there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import named
from tableflow.operators.contracts import require_columns
from tableflow.sources.scratch import written

#: Which bounds belong to a range.
INCLUDED = ("low", "high", "both", "neither")

_BIN, _POINTS, _RANGES = "__bin", "__share_of_points", "__share_of_ranges"
_NUMBER = "__row_number"

#: Sampled rows from which cut points are good enough; with fewer, all rows are taken.
_ENOUGH = 20_000


@dataclass(frozen=True)
class RangeSplit:
    """How finely points are binned, and from how many rows of a side on a bin is split further."""

    rows_per_bin: int = 10_000
    rows_per_task: int = 1_000_000
    max_bins: int = 4_095
    sample_fraction: float = 0.01

    def __post_init__(self) -> None:
        if min(self.rows_per_bin, self.rows_per_task, self.max_bins) <= 0 or not 0 < self.sample_fraction <= 1:
            raise ValueError("Sizes of a split must be greater than zero, and the fraction at most one")


class Joined(NamedTuple):
    """Pairs with the columns of both sides under the aliases ``target`` (points) and ``source`` (ranges)."""

    pairs: DataFrame
    scratch: list[str]


def _ordinal(value: Column, kind: T.DataType) -> Column:
    """A double that never falls where the value rises; null for what no range can hold."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(value.cast("date")) * F.lit(86400.0)
        return day + F.hour(value) * 3600 + F.minute(value) * 60 + F.date_part(F.lit("SECOND"), value).cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    raise ValueError(f"Ranges need numbers, dates or timestamps, got {kind.simpleString()}")


def _kind(df: DataFrame, column: str) -> T.DataType:
    return df.select(named(column)).schema[0].dataType


def _cut_points(points: DataFrame, ordinal: Column, split: RangeSplit) -> list[float]:
    """Ascending numbers that divide the points about evenly; empty where one bin will do."""
    values = points.select(ordinal.alias("x")).where("x IS NOT NULL AND abs(x) < double('Infinity')")
    rows, n = values, 0
    for fraction in sorted({split.sample_fraction, 1.0}):
        rows = values if fraction == 1 else values.sample(fraction, seed=17)
        n = rows.count()
        if n >= _ENOUGH:
            break
    bins = min(split.max_bins + 1, -(-int(n / fraction) // split.rows_per_bin))
    if bins <= 1:
        return []
    shares = ",".join(f"{i / bins!r}D" for i in range(1, bins))
    found = rows.agg(F.expr(f"percentile_approx(x, array({shares}), {max(10_000, 4 * bins)})").alias("cuts")).first()
    return sorted(set(found["cuts"]))


def _bin_of(ordinal: Column, cuts: list[float]) -> Column:
    """How many cut points are not above the value, by bisection."""
    if not cuts:
        return F.when(ordinal.isNotNull(), F.lit(0))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    listed = F.expr("array(" + ",".join(f"{c!r}D" for c in cuts) + ")")
    halves = F.expr("array(" + ",".join(map(str, steps)) + ")")

    def further(place: Column, step: Column) -> Column:
        fits = place + step <= len(cuts)
        return F.when(fits & (F.get(listed, place + step - 1) <= ordinal), place + step).otherwise(place)

    return F.when(ordinal.isNotNull(), F.aggregate(halves, F.lit(0), further))


def _shares(binned: DataFrame, split: RangeSplit) -> dict[int, int]:
    """In how many shares the bins with too many rows are split. One row per bin comes to the driver, at most."""
    counted = binned.groupBy(_BIN).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split.rows_per_task)
    return {r[_BIN]: -(-r["n"] // split.rows_per_task) for r in counted.collect()}


def _lookup(shares: dict[int, int]) -> Column:
    """The number of shares of the row's bin; 1 for most."""
    if not shares:
        return F.lit(1)
    return F.coalesce(F.expr("map(" + ",".join(f"{b},{n}" for b, n in shares.items()) + ")")[F.col(_BIN)], F.lit(1))


def _dealt(binned: DataFrame, own: str, other: str, mine: dict[int, int], theirs: dict[int, int], number: Column) -> DataFrame:
    """Each row in one share of its own side, and copied to all shares of the other's."""
    share = F.pmod(number, _lookup(mine)).cast("int")
    dealt = binned.withColumn(own, share if mine else F.lit(0))
    if not theirs:
        return dealt.withColumn(other, F.lit(0))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), _lookup(theirs) - 1)))


def range_pairs(
    target: DataFrame,
    source: DataFrame,
    *,
    point: str,
    low: str,
    high: str,
    included: str = "low",
    condition: Column | None = None,
    split: RangeSplit | None = None,
) -> Joined:
    """All pairs of a ``target`` row and a ``source`` row where ``point`` lies between ``low`` and ``high``.

    ``included`` says which bounds are part of the range. A null or NaN point lies in no range, and a null or NaN bound makes an empty range, as does
    a low bound above the high one. ``condition`` is a further Column over ``target`` and ``source``. Both sides are read twice.
    """
    if included not in INCLUDED:
        raise ValueError(f"included must be one of {INCLUDED}, got {included!r}")
    require_columns(target, [point])
    require_columns(source, [low, high])
    split = split or RangeSplit()
    first, last = named(low), named(high)
    kinds = [_kind(target, point), _kind(source, low), _kind(source, high)]
    if len({k.simpleString() for k in kinds}) > 1 and not all(isinstance(k, T.NumericType) for k in kinds):
        raise ValueError(f"Points and bounds have different types: {[k.simpleString() for k in kinds]}")
    place, *ends = (_ordinal(c, k) for c, k in zip((named(point), first, last), kinds, strict=True))

    cuts = _cut_points(target, place, split)
    points = target.withColumn(_BIN, _bin_of(place, cuts)).where(F.col(_BIN).isNotNull())
    bins = F.sequence(*(_bin_of(e, cuts) for e in ends))
    ranges = source.where((first <= last) & ends[0].isNotNull() & ends[1].isNotNull())
    ranges = ranges.withColumn(_BIN, F.explode(bins))

    of_points, of_ranges = _shares(points, split), _shares(ranges, split)
    scratch = []
    number = F.lit(0)
    if of_points or of_ranges:  # rows that get a number are written before it is used
        sides = []
        for side in (points, ranges):
            stored, path = written(side.withColumn(_NUMBER, F.monotonically_increasing_id()), "binned")
            sides.append(stored)
            scratch.append(path)
        points, ranges = sides
        number = F.col(_NUMBER)
    points = _dealt(points, _POINTS, _RANGES, of_points, of_ranges, number)
    ranges = _dealt(ranges, _RANGES, _POINTS, of_ranges, of_points, number)

    def column(side: str, name: str) -> Column:
        return F.col(side + ".`" + name.replace("`", "``") + "`")

    meets = F.lit(True) if condition is None else condition
    for name in (_BIN, _POINTS, _RANGES):
        meets &= column("target", name) == column("source", name)
    value = column("target", point)
    above = value >= column("source", low) if included in ("low", "both") else value > column("source", low)
    below = value <= column("source", high) if included in ("high", "both") else value < column("source", high)
    return Joined(points.alias("target").join(ranges.alias("source"), meets & above & below), scratch)


def interval_join(
    points: DataFrame,
    ranges: DataFrame,
    *,
    point: str,
    low: str,
    high: str,
    included: str = "low",
    condition: Column | None = None,
    split: RangeSplit | None = None,
) -> DataFrame:
    """The columns of ``points`` and then of ``ranges``, for each point and each range that holds it.

    See :func:`range_pairs`. In ``condition`` the sides are called ``target`` and ``source``. Columns of both sides should have different names.
    """
    pairs = range_pairs(
        points, ranges, point=point, low=low, high=high, included=included, condition=condition, split=split
    ).pairs
    quoted = lambda side, df: [F.col(f"{side}.`" + c.replace("`", "``") + "`") for c in df.columns]
    return pairs.select(*quoted("target", points), *quoted("source", ranges))
