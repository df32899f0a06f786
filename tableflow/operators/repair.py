"""Late and corrected ticks in a stored indicator table, without computing it anew.

A tick decides its own row and the ``INDICATOR_HISTORY`` rows after it in its series. To find them without sorting whole series, rows are counted
per series and time bucket, which is one aggregation combined in the map tasks. From the counts follow the buckets that can hold rows
up to so many before and after a changed tick. Only their rows are read, sorted and computed, in stretches of neighbouring
buckets, and of these only rows behind a changed tick are returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.functions.columns import named
from tableflow.operators.contracts import require_columns
from tableflow.operators.indicators import INDICATOR_HISTORY, indicators
from tableflow.operators.segments import Split, trailing
from tableflow.operators.skew import fits_broadcast
from tableflow.sources.scratch import written

ADDED = ["moving_avg_14", "rsi_14", "ema_fast_12", "ema_slow_26", "macd", "macd_signal_9"]

_CHANGED, _BUCKET, _STRETCH, _REACHED = "__changed", "__bucket", "__stretch", "__reached"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    quoted = lambda side, c: F.col(f"{side}.`" + c.replace("`", "``") + "`")
    return reduce(Column.__and__, (quoted(left, c).eqNullSafe(quoted(right, c)) for c in columns))


def replace_rows(stored: DataFrame, rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``stored`` with ``rows`` in place of its rows with the same ``ids``, or besides them. Null ids equal each other."""
    listed = _small(rows.select(*map(named, ids)))
    kept = stored.alias("stored").join(listed.alias("new"), _same("stored", "new", ids), "left_anti")
    return kept.unionByName(rows.select(*map(named, stored.columns)))


def repair_indicators(
    stored: DataFrame,
    changes: DataFrame,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    bucket: str = "1 hour",
    split: Split | None = None,
) -> DataFrame:
    """The rows of an indicator table that change, with their new values, after ticks were added or corrected.

    ``stored`` is what :func:`tableflow.indicators` gave for the ticks before, as a stored table. ``changes`` holds ticks with the same key, time
    and tiebreak columns as a stored one, which it corrects, or with new ones; none may occur twice. Columns of the stored table that changes
    lack are null. ``bucket`` is the width of the time buckets; some hundred rows to a bucket are good. It decides how much is
    read, never the result. Put the rows in place with :func:`replace_rows`, or upsert them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ids = [*keys, time, *tiebreak]
    require_columns(stored, [*ids, price, *ADDED])
    require_columns(changes, [*ids, price])
    columns = [c for c in stored.columns if c not in ADDED]
    new = changes.select(*(named(c) if c in changes.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in columns))
    ticks = replace_rows(
        stored.select(*map(named, columns)).withColumn(_CHANGED, F.lit(0)), new.withColumn(_CHANGED, F.lit(1)), ids
    )
    # ticks without a time, which F.window would leave out, have a bucket of their own
    filled = F.coalesce(named(time), F.lit("1970-01-01 00:00:00").cast(stored.schema[time].dataType))
    ticks = ticks.withColumn(_BUCKET, F.window(filled, bucket)["start"])
    ticks = ticks.withColumn(_BUCKET, F.when(named(time).isNotNull(), F.col(_BUCKET)))

    near = _small(_near_buckets(ticks, keys))
    at = [*keys, _BUCKET]
    here = ticks.alias("t").join(near.alias("n"), _same("t", "n", at))
    rows = here.select(*(F.col("t.`" + c.replace("`", "``") + "`") for c in [*columns, _CHANGED]), F.col(f"n.{_STRETCH}"))
    rows, _ = written(rows, "stretches")
    parts, order = [*keys, _STRETCH], [time, *tiebreak]

    def reach(df: DataFrame, w: Window) -> DataFrame:
        frame = w.rowsBetween(-INDICATOR_HISTORY, Window.currentRow)
        return df.withColumn(_REACHED, F.max(named(_CHANGED)).over(frame))

    reached = trailing(rows, parts, order, INDICATOR_HISTORY, [_CHANGED], reach, split)
    computed = indicators(reached, tiebreak=tiebreak, key=parts, time=time, price=price, split=split)
    return computed.where(named(_REACHED) == 1).select(*map(named, stored.columns))


def _near_buckets(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, stretch) of the buckets that may hold a row ``INDICATOR_HISTORY`` before or after a changed tick."""
    counted, _ = written(
        ticks.groupBy(*map(named, keys), _BUCKET).agg(F.count(F.lit(1)).alias("n"), F.max(_CHANGED).alias("changed")), "buckets"
    )
    series = Window.partitionBy(*map(named, keys))
    up, down = series.orderBy(F.col(_BUCKET).asc_nulls_first()), series.orderBy(F.col(_BUCKET).desc_nulls_last())
    before = (Window.unboundedPreceding, -1)
    summed = counted.withColumns(
        {"earlier": F.coalesce(F.sum("n").over(up.rowsBetween(*before)), F.lit(0)), "hit": F.col("changed") == 1}
    )
    # rows between a bucket and the nearest changed one on either side
    end = F.last(F.when(F.col("hit"), F.col("earlier") + F.col("n")), True).over(up.rowsBetween(*before))
    begin = F.last(F.when(F.col("hit"), F.col("earlier")), True).over(down.rowsBetween(*before))
    reach = F.lit(INDICATOR_HISTORY)
    near = F.col("hit") | (F.col("earlier") - F.col("end") < reach) | (F.col("begin") - F.col("earlier") - F.col("n") < reach)
    marked = summed.withColumns({"end": end, "begin": begin}).withColumn("near", F.coalesce(near, F.lit(False)))
    starts = F.col("near") & ~F.coalesce(F.lag("near").over(up), F.lit(False))
    numbered = marked.withColumn("start", starts.cast("int")).withColumn(
        _STRETCH, F.sum("start").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return written(numbered.where("near").select(*map(named, keys), _BUCKET, _STRETCH), "near")[0]
