"""Segmented windows give what plain windows give, whatever the skew."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tableflow import Split, bollinger, indicator_tail, indicators, macd, moving_average, price_delta, rsi
from tableflow.operators import segments

START = datetime(2026, 1, 1)
SCHEMA = "symbol string, event_time timestamp_ntz, n bigint, close double"
PLAIN = Split(rows_per_segment=1_000_000)
ORDER = ["event_time", "n"]


def skewed(spark, seed=1):
    """A hot series, one with gaps, a hot instant, null keys, null times, and short series."""
    rng = random.Random(seed)
    rows = [("HOT", START + timedelta(seconds=i), 0) for i in range(600)]
    rows += [("GAPS", START + timedelta(seconds=rng.randrange(600)), 0) for _ in range(60)]
    rows += [("INSTANT", START + timedelta(seconds=300), 0) for _ in range(400)]
    rows += [("INSTANT", START + timedelta(seconds=i), 0) for i in range(0, 600, 50)]
    rows += [(None, START + timedelta(seconds=2 * i), 0) for i in range(200)]
    rows += [("NULLTIME", None, 0) for _ in range(150)]
    rows += [(f"S{k}", START + timedelta(seconds=i), 0) for k in range(20) for i in range(k)]
    full = [
        (s, t, i, None if rng.random() < 0.05 else round(rng.uniform(1, 100), 2))
        for i, (s, t, _) in enumerate(rows)
    ]
    rng.shuffle(full)
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))


CALLS = {
    "indicators": lambda df, split: indicators(df, tiebreak=["n"], split=split),
    "price_delta": lambda df, split: price_delta(df, tiebreak=["n"], split=split),
    "moving_average": lambda df, split: moving_average(df, 14, tiebreak=["n"], split=split),
    "rsi": lambda df, split: rsi(df, 14, tiebreak=["n"], split=split),
    "macd": lambda df, split: macd(df, 5, 40, tiebreak=["n"], split=split),
    "bollinger": lambda df, split: bollinger(df, 20, tiebreak=["n"], split=split),
    "period_one": lambda df, split: moving_average(df, 1, tiebreak=["n"], split=split),
}


@pytest.mark.parametrize("name", CALLS)
@pytest.mark.parametrize("rows_per_segment", [3, 50])
def test_equal_to_plain(spark, name, rows_per_segment):
    df = skewed(spark)
    plain = as_set(CALLS[name](df, PLAIN))
    cut = as_set(CALLS[name](df, Split(rows_per_segment=rows_per_segment)))
    assert cut == plain


@pytest.mark.parametrize("name", ["indicators", "price_delta"])
def test_copies_without_any_tiebreak_are_split(spark, name):
    """Half of all rows are equal in every column."""
    rows = [("A", START + timedelta(seconds=i), float(i % 13)) for i in range(200)]
    rows += [("A", START + timedelta(seconds=90, milliseconds=5), 7.5)] * 400
    rows += [("B", START + timedelta(seconds=i), float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "symbol string, event_time timestamp_ntz, close double")
    df = df.repartition(4)
    call = {"indicators": indicators, "price_delta": price_delta}[name]
    split = Split(rows_per_segment=40)
    cut = call(df, tiebreak=[], split=split)
    plain = call(df, tiebreak=[], split=PLAIN)
    assert cut.columns == plain.columns
    assert as_set(cut) == as_set(plain)
    sizes = pieces(df, ["symbol"], ["event_time"], split).groupBy("symbol", segments.SEGMENT).count()
    assert sizes.agg(F.max("count")).first()[0] <= 80
    assert sizes.filter("symbol = 'A'").count() >= 10


def pieces(df, keys, order, split):
    listed, n = segments.long_series(df, keys, split)
    rows = df.withColumn(segments._KEY, segments._key(keys)).join(listed, segments._KEY, "left_semi")
    return segments._cut(rows, keys, order, split, n)


def test_only_rows_of_long_series_are_written(spark):
    df = skewed(spark)
    listed, n = segments.long_series(df, ["symbol"], Split(rows_per_segment=150))
    keys = {r[0].k0 for r in listed.collect()}
    assert keys == {"HOT", "INSTANT", None} and n == 600 + 412 + 200
    assert pieces(df, ["symbol"], ORDER, Split(rows_per_segment=150)).count() == n


def test_segments_are_balanced_even_at_one_instant(spark):
    sizes = pieces(skewed(spark), ["symbol"], ORDER, Split(rows_per_segment=50))
    sizes = sizes.groupBy("symbol", segments.SEGMENT).count()
    assert {r.symbol for r in sizes.collect()} == {"HOT", "INSTANT", "GAPS", "NULLTIME", None}
    assert sizes.agg(F.max("count")).first()[0] <= 120
    assert sizes.filter("symbol = 'INSTANT'").count() >= 5


def test_history_reaches_over_short_segments(spark):
    """Segments of about ten rows: the 33 rows before one come from several others."""
    cut = pieces(skewed(spark), ["symbol"], ORDER, Split(rows_per_segment=10))
    total = [*ORDER, segments._ROW]
    earlier = segments.history_rows(cut, ["symbol"], total, 33, ["close"])
    counts = {(r[0], r[1]): r[2] for r in earlier.groupBy("symbol", segments.SEGMENT).count().collect()}
    before = {}
    for symbol, segment, n in sorted(
        map(tuple, cut.groupBy("symbol", segments.SEGMENT).count().collect()), key=lambda r: (str(r[0]), r[1])
    ):
        assert counts.get((symbol, segment), 0) == min(33, before.get(symbol, 0))
        before[symbol] = before.get(symbol, 0) + n


def test_rows_are_read_once_more_only_for_long_series(spark):
    df = skewed(spark)
    plan = indicators(df, tiebreak=["n"], split=PLAIN)._jdf.queryExecution().toString()
    assert segments.SEGMENT not in plan


@pytest.mark.parametrize("split", [PLAIN, Split(rows_per_segment=40)])
def test_since_equals_filtering_the_whole_table(spark, split):
    df = skewed(spark).filter("event_time is not null")
    start = F.lit("2026-01-01 00:05:00").cast("timestamp_ntz")
    whole = indicators(df, tiebreak=["n"], split=PLAIN).filter(F.col("event_time") >= start)
    assert as_set(indicators(df, tiebreak=["n"], split=split, since=start)) == as_set(whole)


def test_since_with_a_stored_tail_reads_new_rows_only(spark, tmp_path):
    df = skewed(spark)
    tail, path = None, str(tmp_path / "tail")
    for k, (low, high) in enumerate([(None, "00:02:00"), ("00:02:00", "00:06:30"), ("00:06:30", "09:00:00")]):
        part = df.filter(F.col("event_time") < f"2026-01-01 {high}")
        if low:
            part = part.filter(F.col("event_time") >= f"2026-01-01 {low}")
            start = F.lit(f"2026-01-01 {low}").cast("timestamp_ntz")
            got = indicators(part, tiebreak=["n"], since=start, earlier=tail)
            whole = indicators(df.filter("event_time is not null"), tiebreak=["n"])
            whole = whole.filter((F.col("event_time") >= start) & (F.col("event_time") < f"2026-01-01 {high}"))
            assert as_set(got) == as_set(whole)
            part = part.select(*tail.columns).unionByName(tail)
        indicator_tail(part, tiebreak=["n"]).write.parquet(f"{path}{k}")
        tail = spark.read.parquet(f"{path}{k}")


def test_other_columns_are_kept(spark):
    df = skewed(spark).withColumns({"a.b": F.col("n") * 2, "x": F.struct("n", "close")})
    plain = indicators(df, tiebreak=["n"], split=PLAIN)
    cut = indicators(df, tiebreak=["n"], split=Split(rows_per_segment=40))
    assert cut.columns == plain.columns
    assert as_set_quoted(cut) == as_set_quoted(plain)


def as_set_quoted(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_since_keeps_rows_without_time_as_history(spark):
    df = skewed(spark)
    whole = indicators(df, tiebreak=["n"]).filter("event_time >= '2026-01-01 00:05:00'")
    assert as_set(indicators(df, tiebreak=["n"], since="2026-01-01 00:05:00")) == as_set(whole)


def test_split_by_two_keys(spark):
    df = skewed(spark).withColumn("venue", (F.col("n") % 2).cast("int"))
    keys = ["symbol", "venue"]
    plain = moving_average(df, 10, key=keys, tiebreak=["n"], split=PLAIN)
    cut = moving_average(df, 10, key=keys, tiebreak=["n"], split=Split(rows_per_segment=30))
    assert as_set(cut) == as_set(plain)


def test_order_by_other_types(spark):
    """Text, double, date and zoned times survive as cut points."""
    df = skewed(spark).select(
        "symbol",
        F.col("event_time").cast("timestamp").alias("event_time"),
        F.concat(F.lit('q"\\'), F.col("n").cast("string")).alias("t"),
        F.when(F.col("n") % 5 == 0, float("nan"))
        .when(F.col("n") % 7 == 0, float("inf"))
        .otherwise(F.col("n") / 7)
        .alias("x"),
        (F.col("n") / 3).cast("decimal(20,5)").alias("m"),
        (F.col("n") % 2 == 0).alias("b"),
        F.col("n").cast("string").cast("binary").alias("y"),
        F.to_date("event_time").alias("d"),
        "close",
    )
    for tiebreak in (["t"], ["x", "m"], ["b", "y"], ["d", "x", "t"]):
        plain = moving_average(df, 10, tiebreak=tiebreak, split=PLAIN)
        cut = moving_average(df, 10, tiebreak=tiebreak, split=Split(rows_per_segment=30))
        assert as_set(cut) == as_set(plain)


def test_zoned_times_across_a_clock_change(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.range(600).select(
            F.lit("A").alias("symbol"),
            F.timestamp_seconds(F.lit(1793505600) + F.col("id") * 30).alias("event_time"),
            (F.col("id") * 7 % 31).cast("double").alias("close"),
        )
        plain = moving_average(df, 10, tiebreak=[], split=PLAIN)
        cut = moving_average(df, 10, tiebreak=[], split=Split(rows_per_segment=30))
        assert as_set(cut) == as_set(plain)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_long_series_are_found_in_a_sample(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("symbol"),
        F.timestamp_seconds("id").alias("event_time"),
        (F.col("id") * 31 % 17).cast("double").alias("close"),
    )
    split = Split(rows_per_segment=5_000)
    listed, n = segments.long_series(df, ["symbol"], split)
    assert [r[0].k0 for r in listed.collect()] == ["HOT"]
    assert 20_000 < n < 40_000
    cut = price_delta(df, tiebreak=[], split=split)
    assert segments.SEGMENT in cut._jdf.queryExecution().toString()
    assert as_set(cut) == as_set(price_delta(df, tiebreak=[], split=PLAIN))


def test_bad_split():
    with pytest.raises(ValueError, match="rows_per_segment"):
        Split(rows_per_segment=0)
