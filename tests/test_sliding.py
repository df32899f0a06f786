"""Long frames merged from small ones, against frames that are added up row by row."""

import math
import random
from decimal import Decimal
from statistics import pstdev

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tableflow import Split, bollinger, bollinger_latest, macd, moving_average, rsi
from tableflow.operators import indicators
from tableflow.operators.sliding import add, merge_moments, sliding

SCHEMA = "symbol string, event_time int, close double"


def ticks(spark, series):
    return spark.createDataFrame([(k, i, v) for k, values in series.items() for i, v in enumerate(values)], SCHEMA)


def column(df, name):
    return {(r["symbol"], r["event_time"]): r[name] for r in df.collect()}


def frames(values, period):
    for i in range(len(values)):
        frame = values[i + 1 - period : i + 1] if i + 1 >= period else [None]
        yield i, None if None in frame else frame


def close_to(got, want):
    if want is None or got is None:
        return got is want
    if math.isnan(want):
        return math.isnan(got)
    return got == want or abs(got - want) <= 1e-9 * max(1.0, abs(want))


def random_series(rng, n):
    out = {"long": [rng.uniform(10, 90) for _ in range(n)], "short": [1.0] * 40, "nulls": [rng.uniform(1, 9) for _ in range(n)]}
    out["nulls"][n // 3] = out["nulls"][n // 3 + 1] = None
    out["nan"] = [rng.uniform(1, 9) for _ in range(n)]
    out["nan"][n // 4] = float("nan")
    out["spike"] = [rng.uniform(1, 9) for _ in range(n)]
    out["spike"][n // 5] = 1e300
    return out


@pytest.mark.parametrize("period", [1, 7, 8, 9, 63, 64, 65, 200, 513])
def test_sums_and_moments_of_any_period(spark, period):
    rng = random.Random(period)
    series = random_series(rng, 700)
    w = Window.partitionBy("symbol").orderBy("event_time")
    rows = ticks(spark, series).withColumns({"v": F.col("close"), "z": F.col("close") * 0})
    sums, names = sliding(rows, w, ["v"], [period, 10], add)
    both, moments = sliding(rows, w, ["v", "z"], [period], merge_moments)
    total, ten = column(sums, names[period][0]), column(sums, names[10][0])
    mean, square = (column(both, c) for c in moments[period])
    for symbol, values in series.items():
        for i, frame in frames(values, period):
            assert close_to(total[symbol, i], None if frame is None else math.fsum(frame))
            if symbol != "spike" or frame is None or max(frame) < 1e9:
                assert close_to(mean[symbol, i], None if frame is None else math.fsum(frame) / period)
                want = None if frame is None else float("nan") if any(map(math.isnan, frame)) else pstdev(frame) ** 2 * period
                assert close_to(square[symbol, i], want)
        for i, frame in frames(values, 10):
            assert close_to(ten[symbol, i], None if frame is None else math.fsum(frame))


@pytest.mark.parametrize("split", [None, Split(rows_per_segment=90)])
def test_long_periods_equal_direct_frames(spark, monkeypatch, split):
    series = random_series(random.Random(2), 400)
    df = ticks(spark, series)

    def every():
        how = {"tiebreak": [], "split": split}
        bands = bollinger(df, 150, tiebreak=[], split=split)
        yield from (column(bands, c) for c in ("bb_lower", "bb_mid", "bb_upper"))
        yield column(moving_average(df, 100, **how), "moving_avg")
        yield column(rsi(df, 100, **how), "rsi")
        yield column(macd(df, 20, 130, **how), "macd")

    long = list(every())
    monkeypatch.setattr(indicators, "DIRECT_ROWS", 10_000)
    for got, want in zip(long, every(), strict=True):
        assert got.keys() == want.keys()
        for key, value in want.items():
            if key[0] != "spike":
                assert close_to(got[key], value), (key, got[key], value)


def test_columns_and_types_stay_the_same(spark, monkeypatch):
    df = ticks(spark, {"a": [float(i) for i in range(120)]}).withColumn("close", F.col("close").cast("decimal(12,3)"))
    def schemas():
        made = (moving_average(df, 70, tiebreak=[]), bollinger(df, 70, tiebreak=[]), macd(df, 3, 70, tiebreak=[]), rsi(df, 70, tiebreak=[]))
        return [[(f.name, f.dataType) for f in x.schema.fields] for x in made]

    long, values = schemas(), column(moving_average(df, 70, tiebreak=[]), "moving_avg")
    assert values["a", 69] == Decimal("34.5") and values["a", 68] is None
    monkeypatch.setattr(indicators, "DIRECT_ROWS", 10_000)
    assert long == schemas()


def test_one_shuffle_and_one_sort_for_any_period(spark):
    df = ticks(spark, {"a": [1.0, 2.0]})
    for period in (65, 4_000, 100_000):
        plan = moving_average(df, period, tiebreak=[])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    assert plan.count("Window ") <= 6


def test_latest_bands_of_a_period_beyond_the_rank_limit(spark):
    values = [math.sin(i) for i in range(1_300)]
    row = bollinger_latest(ticks(spark, {"a": values}), 1_100, 3.0, tiebreak=[]).first()
    mean, spread = math.fsum(values[-1_100:]) / 1_100, 3 * pstdev(values[-1_100:])
    assert [round(row[c], 9) for c in ("bb_lower", "bb_mid", "bb_upper")] == [round(x, 9) for x in (mean - spread, mean, mean + spread)]


def test_wrong_periods(spark):
    w = Window.partitionBy("symbol").orderBy("event_time")
    for periods in ([], [0], [3, -1]):
        with pytest.raises(ValueError):
            sliding(ticks(spark, {"a": [1.0]}), w, ["close"], periods, add)
