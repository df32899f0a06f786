"""Market-style indicators over ordered series.

Two families that must not be mixed:

* ``indicators`` averages over what is there: frames are partial at the start of a series.
* ``moving_average``, ``rsi``, ``macd`` and ``bollinger`` are strict: null until the frame holds
  ``period`` non-null values.

``tiebreak`` names the columns that order rows with equal time. It is a required argument: pass
an empty list only where times are unique within a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tableflow.functions.columns import named
from tableflow.operators.dedupe import latest_per_key
from tableflow.operators.segments import Split, last_rows, since as rows_since, trailing
from tableflow.operators.sliding import add, merge_moments, sliding

# --- Fixed values: periods of the indicator table ------------------------------------------
AVERAGE_ROWS = 14
FAST_ROWS = 12
SLOW_ROWS = 26
SIGNAL_ROWS = 9
# -------------------------------------------------------------------------------------------

#: Earlier rows that decide a row of ``indicators``: the signal reaches back 8 rows, and the slow
#: mean another 25.
INDICATOR_HISTORY = (SIGNAL_ROWS - 1) + (SLOW_ROWS - 1)

#: Frames of more rows are merged from smaller ones instead of being added up for each row.
DIRECT_ROWS = 64

_RANK_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

_DIFF = "__diff"
_GAIN = "__gain"
_LOSS = "__loss"
_VALUE = "__value"
_SQUARE = "__square"


def _keys(key: str | Sequence[str]) -> list[str]:
    keys = [key] if isinstance(key, str) else list(key)
    if not keys:
        raise ValueError("At least one key column is required")
    return keys


def _check_period(period: int, name: str = "period") -> None:
    if period <= 0:
        raise ValueError(f"{name} must be greater than zero, got {period}")


def _last(window: WindowSpec, rows: int) -> WindowSpec:
    return window.rowsBetween(1 - rows, Window.currentRow)


def _difference(price: Column, window: WindowSpec) -> Column:
    return price - F.lag(price, 1).over(window)


def _positive_part(value: Column) -> Column:
    """The value where it is above zero, else 0.0; a null counts as no change."""
    return F.when(value > 0, value).otherwise(F.lit(0.0))


def _drop_part(value: Column) -> Column:
    """How far the value lies below zero, else 0.0; a null or NaN is no drop."""
    return F.when(value < 0, -value).otherwise(F.lit(0.0))


def _strength(gain: Column, loss: Column) -> Column:
    """0-100 strength from mean gain and mean loss; 100 where there is no loss at all."""
    return F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss))


def _when_full(value: Column, counted: Column, rows: int, window: WindowSpec) -> Column:
    return F.when(F.count(counted).over(_last(window, rows)) == rows, value)


def _average_type(rows: DataFrame, value: Column) -> T.DataType:
    return rows.select(F.avg(value)).schema[0].dataType


def _long_means(rows: DataFrame, w: WindowSpec, value: Column, periods: Sequence[int]) -> tuple[DataFrame, list[Column]]:
    """The mean of the last rows for each of ``periods``; null unless all of them hold a value. Helper columns begin with ``__``."""
    kind = _average_type(rows, value)
    wide = T.DecimalType(38, kind.scale - 4) if isinstance(kind, T.DecimalType) else T.DoubleType()

    def total(frames: list, names: list[str]) -> list[dict[str, Column]]:
        return [{n: c.cast(wide) for n, c in step.items()} for step in add(frames, names)]

    rows, sums = sliding(rows.withColumn(_VALUE, value.cast(wide)), w, [_VALUE], periods, total)
    return rows, [(named(sums[p][0]) / p).cast(kind) for p in periods]


def _without_helpers(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*map(named, columns))


def indicators(
    df: DataFrame,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    split: Split | None = None,
    since: str | Column | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Append trailing mean, RSI, MACD line and MACD signal to every row.

    Columns: ``moving_avg_14, rsi_14, ema_fast_12, ema_slow_26, macd, macd_signal_9``. The
    ``ema_*`` columns hold plain trailing means. A NaN difference is a gain of NaN and a loss of 0.0,
    so RSI stays 100 without any other loss. The first row of a series has RSI 100 and
    MACD 0. ``since`` (a timestamp text or Column) returns only rows from that time on. The rows before it
    that decide them come from ``earlier``, a table that :func:`indicator_tail` gave at the end of the run before,
    so that only new rows are read; without it, the keys, times and prices of all rows are.
    """
    keys, order = _keys(key), [time, *tiebreak]
    start = F.lit(since).cast("timestamp") if isinstance(since, str) else since
    source = df
    if start is not None:
        source = rows_since(df, keys, order, start, INDICATOR_HISTORY, [price], earlier)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        # Two levels of window functions with one partitioning and order: one shuffle, one sort.
        close = named(price)
        first = rows.withColumns(
            {
                "moving_avg_14": F.avg(close).over(_last(w, AVERAGE_ROWS)),
                "ema_fast_12": F.avg(close).over(_last(w, FAST_ROWS)),
                "ema_slow_26": F.avg(close).over(_last(w, SLOW_ROWS)),
                _DIFF: _difference(close, w),
            }
        ).withColumns(
            {
                _GAIN: _positive_part(named(_DIFF)),
                _LOSS: _drop_part(named(_DIFF)),
                "macd": named("ema_fast_12") - named("ema_slow_26"),
            }
        )
        return first.withColumns(
            {
                "rsi_14": _strength(
                    F.avg(named(_GAIN)).over(_last(w, AVERAGE_ROWS)),
                    F.avg(named(_LOSS)).over(_last(w, AVERAGE_ROWS)),
                ),
                "macd_signal_9": F.avg(named("macd")).over(_last(w, SIGNAL_ROWS)),
            }
        ).drop(_DIFF, _GAIN, _LOSS)

    result = trailing(source, keys, order, INDICATOR_HISTORY, [price], compute, split)
    if start is not None:
        result = result.filter(named(time) >= start)
    added = ["moving_avg_14", "rsi_14", "ema_fast_12", "ema_slow_26", "macd", "macd_signal_9"]
    kept = [c for c in result.columns if c not in added]
    return result.select(*map(named, kept + added))


def indicator_tail(
    df: DataFrame,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
) -> DataFrame:
    """The rows that the next run of ``indicators`` needs: the last ones of each series.

    Store it after each run. From then on, it is the tail of itself and the new rows.
    """
    return last_rows(df, _keys(key), [time, *tiebreak], INDICATOR_HISTORY, [price])


def price_delta(
    df: DataFrame,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    split: Split | None = None,
) -> DataFrame:
    """Append ``price_diff`` (null on the first row) and its ``gain`` and ``loss`` parts.

    A difference with a NaN has the gain NaN, which is above all numbers, and the loss 0.0.
    """

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("price_diff", _difference(named(price), w)).withColumns(
            {
                "gain": _positive_part(named("price_diff")),
                "loss": _drop_part(named("price_diff")),
            }
        )

    return trailing(df, _keys(key), [time, *tiebreak], 1, [price], compute, split)


def moving_average(
    df: DataFrame,
    period: int,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    name: str = "moving_avg",
    split: Split | None = None,
) -> DataFrame:
    """Append the mean of the last ``period`` rows; null unless all of them hold a value."""
    _check_period(period)
    close = named(price)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        if period > DIRECT_ROWS:
            columns = rows.columns
            rows, (mean,) = _long_means(rows, w, close, [period])
            return _without_helpers(rows.withColumn(name, mean), [*columns, name])
        mean = F.avg(close).over(_last(w, period))
        return rows.withColumn(name, _when_full(mean, close, period, w))

    return trailing(df, _keys(key), [time, *tiebreak], period - 1, [price], compute, split)


def rsi(
    df: DataFrame,
    period: int,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    name: str = "rsi",
    split: Split | None = None,
) -> DataFrame:
    """Append the RSI over exactly ``period`` differences; null for the first ``period`` rows.

    A NaN among them makes both means, and the RSI, NaN.
    """
    _check_period(period)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        diffs = rows.withColumn(_DIFF, _difference(named(price), w))
        if period > DIRECT_ROWS:
            known = F.when(named(_DIFF).isNotNull(), named(_DIFF))
            parts = {_GAIN: _positive_part(known), _LOSS: _positive_part(-known)}
            parts = {c: F.when(named(_DIFF).isNotNull(), part).cast("double") for c, part in parts.items()}
            merged, sums = sliding(diffs.withColumns(parts), w, [_GAIN, _LOSS], [period], add)
            gain, loss = (named(c) / period for c in sums[period])
            strength = F.when(gain.isNotNull(), _strength(gain, loss))
            return _without_helpers(merged.withColumn(name, strength), [*rows.columns, name])
        frame = _last(w, period)
        strength = _strength(
            F.avg(_positive_part(named(_DIFF))).over(frame),
            F.avg(_positive_part(-named(_DIFF))).over(frame),
        )
        return diffs.withColumn(name, _when_full(strength, named(_DIFF), period, w)).drop(_DIFF)

    return trailing(df, _keys(key), [time, *tiebreak], period, [price], compute, split)


def macd(
    df: DataFrame,
    short: int,
    long: int,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    name: str = "macd",
    split: Split | None = None,
) -> DataFrame:
    """Append mean(short) - mean(long); null until both means exist."""
    _check_period(short, "short")
    _check_period(long, "long")
    if short >= long:
        raise ValueError(f"short must be less than long, got {short} and {long}")
    close = named(price)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        if long > DIRECT_ROWS:
            columns = rows.columns
            rows, (fast, slow) = _long_means(rows, w, close, [short, long])
            return _without_helpers(rows.withColumn(name, fast - slow), [*columns, name])
        spread = F.avg(close).over(_last(w, short)) - F.avg(close).over(_last(w, long))
        return rows.withColumn(name, _when_full(spread, close, long, w))

    return trailing(df, _keys(key), [time, *tiebreak], long - 1, [price], compute, split)


def bollinger(
    df: DataFrame,
    period: int,
    k: float = 2.0,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    split: Split | None = None,
) -> DataFrame:
    """Append ``bb_lower, bb_mid, bb_upper``: mean and k population deviations around it."""
    _check_period(period)
    close = named(price)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        if period > DIRECT_ROWS:
            value = close.cast("double")
            start = rows.withColumns({_VALUE: value, _SQUARE: F.when(value.isNotNull(), value - value)})
            merged, found = sliding(start, w, [_VALUE, _SQUARE], [period], merge_moments)
            mean, square = map(named, found[period])
            spread = F.lit(float(k)) * F.sqrt(square / period)
            mid = mean.cast(_average_type(rows, close))
            bands = {"bb_lower": mid - spread, "bb_mid": mid, "bb_upper": mid + spread}
            return _without_helpers(merged.withColumns(bands), [*rows.columns, *bands])
        frame = _last(w, period)
        mean = _when_full(F.avg(close).over(frame), close, period, w)
        spread = F.lit(float(k)) * F.stddev_pop(close).over(frame)
        return rows.withColumns(
            {"bb_lower": mean - spread, "bb_mid": mean, "bb_upper": mean + spread}
        )

    return trailing(df, _keys(key), [time, *tiebreak], period - 1, [price], compute, split)


def bollinger_latest(
    df: DataFrame,
    period: int,
    k: float = 2.0,
    *,
    tiebreak: Sequence[str],
    key: str | Sequence[str] = "symbol",
    time: str = "event_time",
    price: str = "close",
    split: Split | None = None,
) -> DataFrame:
    """One row per series: its last time and the bands over its last ``period`` rows.

    No frame is evaluated per row: the last ``period`` rows of each series are picked by rank,
    which Spark limits before the shuffle, and then aggregated. Spark does not limit ranks above
    its ``windowGroupLimitThreshold``; from there on the bands come from ``bollinger``.
    """
    _check_period(period)
    keys = _keys(key)
    if period > int(df.sparkSession.conf.get(_RANK_LIMIT, "1000")):
        every = bollinger(
            df, period, k, tiebreak=tiebreak, key=keys, time=time, price=price, split=split
        )
        last = latest_per_key(every, keys, time, tiebreak)
        return last.select(*map(named, [*keys, time, "bb_lower", "bb_mid", "bb_upper"]))
    latest_first = Window.partitionBy(*map(named, keys)).orderBy(
        *(named(c).desc_nulls_last() for c in [time, *tiebreak])
    )
    recent = df.withColumn("__rank", F.row_number().over(latest_first)).filter(
        F.col("__rank") <= period
    )
    close = named(price)
    spread = F.lit(float(k)) * F.stddev_pop(close)
    mean = F.when(F.count(close) == period, F.avg(close))
    return recent.groupBy(*map(named, keys)).agg(
        F.max(named(time)).alias(time),
        (mean - spread).alias("bb_lower"),
        mean.alias("bb_mid"),
        (mean + spread).alias("bb_upper"),
    )
