"""Tick-to-bar resampling: open, high, low, close, volume and row count per interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions.columns import named


def bars(
    df: DataFrame,
    interval: str,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    volume: str | None = None,
) -> DataFrame:
    """Bars as ``(key, event_time, open, high, low, close, volume, ticks)``.

    ``event_time`` is the start of the interval. Rows without a time belong to no bar. Works on a
    batch and on a streaming DataFrame with a watermark. All aggregates are combined within each
    map task before the shuffle, so a symbol with a third of all rows adds one row per interval
    and task. With an empty ``tiebreak`` the aggregation state is fixed-width and hashed; with
    tiebreak columns open and close are decided by (time, tiebreak), which sorts instead.
    """
    keys = [key] if isinstance(key, str) else list(key)
    at = F.struct(named(time), *map(named, tiebreak)) if tiebreak else named(time)
    value = named(price)
    amount = F.sum(named(volume)) if volume else F.lit(None).cast("double")
    grouped = (
        df.groupBy(F.window(named(time), interval).alias("__interval"), *map(named, keys))
        .agg(
            F.min_by(value, at).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, at).alias("close"),
            amount.alias("volume"),
            F.count(F.lit(1)).alias("ticks"),
        )
    )
    return grouped.select(
        *map(named, keys),
        F.col("__interval.start").alias(time),
        *map(F.col, ["open", "high", "low", "close", "volume", "ticks"]),
    )


# Bars that can be merged --------------------------------------------------------------------------

_FIRST, _LAST, _END = "first_at", "last_at", "bar_end"


def bar_states(
    df: DataFrame,
    interval: str,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    volume: str | None = None,
) -> DataFrame:
    """Bars as :func:`bars` gives them, and what it takes to merge them: ``bar_end, first_at, last_at``.

    ``first_at`` and ``last_at`` hold (time, tiebreak) of the ticks that gave open and close. Stored, such a table takes in late ticks, see
    :func:`merge_rule`, and gives longer bars, see :func:`roll_up`, without any tick being read again. A tick counts as often as it is given.
    """
    keys = [key] if isinstance(key, str) else list(key)
    at = F.struct(named(time), *map(named, tiebreak))
    value = named(price)
    amount = F.sum(named(volume)) if volume else F.lit(None).cast("double")
    grouped = df.groupBy(F.window(named(time), interval).alias("__interval"), *map(named, keys)).agg(
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        amount.alias("volume"),
        F.count(F.lit(1)).alias("ticks"),
        F.min(at).alias(_FIRST),
        F.max(at).alias(_LAST),
    )
    return grouped.select(
        *map(named, keys),
        F.col("__interval.start").alias(time),
        *map(F.col, ["open", "high", "low", "close", "volume", "ticks"]),
        F.col("__interval.end").alias(_END),
        _FIRST,
        _LAST,
    )


def merge_rule() -> dict[str, Column]:
    """Assignments of an upsert that merge the states of further ticks into stored ones.

    Use them as ``set`` with ``on`` the key and time columns, and ``copy_columns(states.columns)`` as ``insert``; the source must have one state per bar.
    """
    old, new = (lambda name: F.col(f"target.{name}")), (lambda name: F.col(f"source.{name}"))
    return {
        "open": F.when(new(_FIRST) < old(_FIRST), new("open")).otherwise(old("open")),
        "close": F.when(new(_LAST) > old(_LAST), new("close")).otherwise(old("close")),
        "high": F.greatest(old("high"), new("high")),
        "low": F.least(old("low"), new("low")),
        "volume": F.coalesce(old("volume") + new("volume"), old("volume"), new("volume")),
        "ticks": old("ticks") + new("ticks"),
        _FIRST: F.least(old(_FIRST), new(_FIRST)),
        _LAST: F.greatest(old(_LAST), new(_LAST)),
    }


def roll_up(
    states: DataFrame, interval: str | None = None, *, key: str | Sequence[str] = "symbol", time: str = "event_time"
) -> DataFrame:
    """States of bars of a longer ``interval``, or of the same bars where several tables of states were put together.

    A bar that does not lie within one longer interval fails the query. Combined in the map tasks like any aggregation.
    """
    keys = [key] if isinstance(key, str) else list(key)
    start, end = named(time), named(_END)
    if interval is not None:
        states = states.withColumn("__long", F.window(start, interval))
        start, end = F.col("__long.start"), F.col("__long.end")
        message = F.lit(f"A bar does not lie within one interval of {interval}")
        inside = F.when(named(_END) > end, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        states = states.where(inside)
    grouped = states.groupBy(*map(named, keys), start.alias("__start"), end.alias("__end")).agg(
        F.min_by("open", _FIRST).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", _LAST).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("ticks").alias("ticks"),
        F.min(_FIRST).alias(_FIRST),
        F.max(_LAST).alias(_LAST),
    )
    bars_of = ["open", "high", "low", "close", "volume", "ticks"]
    return grouped.select(
        *map(named, keys), F.col("__start").alias(time), *bars_of, F.col("__end").alias(_END), _FIRST, _LAST
    )


def without_state(states: DataFrame) -> DataFrame:
    """The bars of a table of states, as :func:`bars` gives them."""
    return states.drop(_END, _FIRST, _LAST)
