"""Streaming tick-to-bar resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.functions.columns import named
from tableflow.operators.bars import bars


def stream_bars(
    ticks: DataFrame,
    interval: str,
    delay: str,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    volume: str | None = None,
) -> DataFrame:
    """Bars of a stream, each emitted once, after the watermark has passed its end.

    State holds open bars only: keys times the intervals within ``delay``. A time without zone
    is read in the session time zone, since a watermark needs an instant.
    """
    instants = ticks.withColumn(time, named(time).cast("timestamp")).withWatermark(time, delay)
    return bars(
        instants, interval, tiebreak=tiebreak, key=key, time=time, price=price, volume=volume
    )


def open_bars(
    ticks: DataFrame,
    interval: str,
    delay: str,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    volume: str | None = None,
) -> DataFrame:
    """The bars of a batch that a stream over the same ticks still holds back at its end.

    After a backfill, these and what :func:`stream_bars` wrote are all bars. Only the ticks of the last intervals
    are read for them, apart from one aggregation of the times.
    """
    instants = ticks.withColumn(time, named(time).cast("timestamp"))
    last = instants.agg(F.max(named(time)).alias("last")).first()["last"]
    if last is None:
        return bars(
            instants, interval, tiebreak=tiebreak, key=key, time=time, price=price, volume=volume
        )
    passed = F.lit(last) - F.expr(f"INTERVAL {delay}")
    recent = instants.filter(named(time) >= passed - F.expr(f"INTERVAL {interval}"))
    found = bars(recent, interval, tiebreak=tiebreak, key=key, time=time, price=price, volume=volume)
    return found.filter(named(time) + F.expr(f"INTERVAL {interval}") > passed)
