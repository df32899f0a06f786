"""Indicator values against plain-Python definitions and hand-computed rows."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tableflow import (
    Split,
    bollinger,
    bollinger_latest,
    indicators,
    macd,
    moving_average,
    price_delta,
    rsi,
)

START = datetime(2026, 1, 1)
SCHEMA = "symbol string, event_time timestamp_ntz, close double"


def ticks(spark, closes, symbol="BTC"):
    rows = [(symbol, START + timedelta(minutes=i), c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "event_time").collect()]


def mean(values):
    present = [v for v in values if v is not None]
    return sum(present) / len(present) if present else None


def tail(values, i, n):
    return values[max(0, i - n + 1) : i + 1]


def expected_table(closes):
    diffs = [
        None if i == 0 or closes[i] is None or closes[i - 1] is None else closes[i] - closes[i - 1]
        for i in range(len(closes))
    ]
    gains = [d if d is not None and d > 0 else 0.0 for d in diffs]
    losses = [-d if d is not None and d < 0 else 0.0 for d in diffs]
    rows, macds = [], []
    for i in range(len(closes)):
        fast, slow = mean(tail(closes, i, 12)), mean(tail(closes, i, 26))
        gain, loss = mean(tail(gains, i, 14)), mean(tail(losses, i, 14))
        macds.append(None if fast is None or slow is None else fast - slow)
        strength = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        rows.append(
            (mean(tail(closes, i, 14)), strength, fast, slow, macds[i], mean(tail(macds, i, 9)))
        )
    return rows


NAMES = ["moving_avg_14", "rsi_14", "ema_fast_12", "ema_slow_26", "macd", "macd_signal_9"]


def assert_close(found, expected):
    assert len(found) == len(expected)
    for f, e in zip(found, expected):
        if e is None or f is None:
            assert f is None and e is None
        else:
            assert f == pytest.approx(e, abs=1e-9)


@pytest.mark.parametrize("rows_per_segment", [1_000_000, 7])
def test_table_matches_definition(spark, rows_per_segment):
    closes = [100 + 10 * math.sin(i * 1.7) + (i * 37 % 11) for i in range(90)]
    closes[20] = closes[21] = None
    df = indicators(
        ticks(spark, closes), tiebreak=[], split=Split(rows_per_segment=rows_per_segment)
    )
    rows = df.orderBy("event_time").collect()
    for i, name in enumerate(NAMES):
        assert_close([r[name] for r in rows], [e[i] for e in expected_table(closes)])


def test_four_ticks(spark):
    rows = indicators(ticks(spark, [100.0, 102.0, 101.0, 105.0]), tiebreak=[]).orderBy("event_time")
    last = rows.collect()[-1]
    assert last["moving_avg_14"] == 102.0
    assert last["rsi_14"] == pytest.approx(100 - 100 / (1 + 6 / 1))
    assert last["macd"] == 0.0 and last["macd_signal_9"] == 0.0


def test_first_row_of_partial_family(spark):
    row = indicators(ticks(spark, [5.0]), tiebreak=[]).first()
    assert [row[n] for n in NAMES] == [5.0, 100.0, 5.0, 5.0, 0.0, 0.0]


def test_flat_series_has_full_strength(spark):
    df = ticks(spark, [3.0] * 20)
    assert set(column(indicators(df, tiebreak=[]), "rsi_14")) == {100.0}
    assert column(rsi(df, 5, tiebreak=[]), "rsi") == [None] * 5 + [100.0] * 15


def test_input_columns_are_kept_in_front(spark):
    df = indicators(ticks(spark, [1.0]).withColumn("extra", F.lit(1)), tiebreak=[])
    assert df.columns == ["symbol", "event_time", "close", "extra", *NAMES]


def test_null_close_gives_no_change_next_to_it(spark):
    rows = price_delta(ticks(spark, [10.0, None, 12.0, 15.0]), tiebreak=[]).orderBy("event_time")
    assert [(r.price_diff, r.gain, r.loss) for r in rows.collect()] == [
        (None, 0.0, 0.0),
        (None, 0.0, 0.0),
        (None, 0.0, 0.0),
        (3.0, 3.0, 0.0),
    ]


def test_nan_stays_in_its_frames(spark):
    closes = [1.0] * 5 + [float("nan")] + [1.0] * 20
    found = column(moving_average(ticks(spark, closes), 3, tiebreak=[]), "moving_avg")
    assert [i for i, v in enumerate(found) if v is not None and math.isnan(v)] == [5, 6, 7]
    assert found[8:] == [1.0] * 18


def test_strict_moving_average(spark):
    found = column(
        moving_average(ticks(spark, [10.0, 20.0, 30.0, 40.0, 50.0]), 3, tiebreak=[]), "moving_avg"
    )
    assert found == [None, None, 20.0, 30.0, 40.0]


def test_strict_is_null_around_a_null(spark):
    found = column(
        moving_average(ticks(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]), 2, tiebreak=[]), "moving_avg"
    )
    assert found == [None, 1.5, None, None, 4.5, 5.5]


def test_strict_rsi(spark):
    closes = [10.0, 11.0, 10.5, 12.0, 11.0, 11.0, 13.0]
    found = column(rsi(ticks(spark, closes), 3, tiebreak=[]), "rsi")
    expected = [None] * 3
    for i in range(3, len(closes)):
        diffs = [closes[j] - closes[j - 1] for j in range(i - 2, i + 1)]
        gain = sum(d for d in diffs if d >= 0) / 3
        loss = sum(-d for d in diffs if d < 0) / 3
        expected.append(100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
    assert_close(found, expected)


def test_strict_macd(spark):
    closes = [1.0, 2.0, 4.0, 7.0, 11.0]
    found = column(macd(ticks(spark, closes), 2, 4, tiebreak=[]), "macd")
    assert_close(found, [None, None, None, 5.5 - 3.5, 9.0 - 6.0])


def test_bollinger_uses_population_deviation(spark):
    closes = [10.0, 12.0, 13.0, 15.0, 18.0, 20.0]
    rows = bollinger(ticks(spark, closes), 5, 2.0, tiebreak=[]).orderBy("event_time").collect()
    assert all(rows[i].bb_mid is None and rows[i].bb_lower is None for i in range(4))
    last = closes[1:]
    mid = sum(last) / 5
    deviation = math.sqrt(sum((v - mid) ** 2 for v in last) / 5)
    assert (rows[5].bb_lower, rows[5].bb_mid, rows[5].bb_upper) == pytest.approx(
        (mid - 2 * deviation, mid, mid + 2 * deviation)
    )
    assert rows[5].bb_lower < rows[5].bb_mid < rows[5].bb_upper


def test_bollinger_latest_is_the_last_row(spark):
    long, short = ticks(spark, [float(i % 7) for i in range(30)]), ticks(spark, [1.0, 2.0], "ETH")
    both = long.unionByName(short)
    latest = {r.symbol: r for r in bollinger_latest(both, 20, tiebreak=[]).collect()}
    full = bollinger(both, 20, tiebreak=[]).filter("symbol = 'BTC'").orderBy("event_time")
    last = full.collect()[-1]
    assert latest["BTC"].event_time == last.event_time
    assert latest["BTC"].bb_upper == pytest.approx(last.bb_upper)
    assert latest["BTC"].bb_lower == pytest.approx(last.bb_lower)
    assert latest["ETH"].bb_mid is None and latest["ETH"].event_time is not None


def test_bollinger_latest_of_long_periods(spark):
    df = ticks(spark, [float(i % 7) for i in range(60)]).unionByName(ticks(spark, [1.0], "ETH"))
    short = bollinger_latest(df, 20, tiebreak=[]).orderBy("symbol").collect()
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    try:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
        split = Split(rows_per_segment=25)
        long = bollinger_latest(df, 20, tiebreak=[], split=split).orderBy("symbol").collect()
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    assert [r[:2] for r in long] == [r[:2] for r in short]
    assert long[0].bb_upper == pytest.approx(short[0].bb_upper)
    assert long[0].bb_lower == pytest.approx(short[0].bb_lower)
    assert long[1].bb_mid is None


def test_short_series_gives_nulls_not_errors(spark):
    df = ticks(spark, [1.0, 2.0])
    assert column(moving_average(df, 3, tiebreak=[]), "moving_avg") == [None, None]
    assert column(rsi(df, 2, tiebreak=[]), "rsi") == [None, None]
    assert moving_average(df.limit(0), 3, tiebreak=[]).collect() == []


def test_tiebreak_decides_equal_times(spark):
    rows = [("A", START, 1.0, 2), ("A", START, 5.0, 1), ("A", START, 9.0, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", n int").repartition(3)
    found = price_delta(df, tiebreak=["n"]).orderBy("n").collect()
    assert [r.price_diff for r in found] == [None, -4.0, 8.0]


@pytest.mark.parametrize("period", [0, -1])
def test_bad_periods(spark, period):
    df = ticks(spark, [1.0])
    for call in (moving_average, rsi, bollinger, bollinger_latest):
        with pytest.raises(ValueError, match="greater than zero"):
            call(df, period, tiebreak=[])


def test_macd_arguments(spark):
    with pytest.raises(ValueError, match="less than"):
        macd(ticks(spark, [1.0]), 26, 12, tiebreak=[])


def test_tiebreak_is_required(spark):
    with pytest.raises(TypeError):
        indicators(ticks(spark, [1.0]))
