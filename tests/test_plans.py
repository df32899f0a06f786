"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tableflow import (
    HotKeys,
    Split,
    bars,
    bollinger_latest,
    clean_distinct,
    indicators,
    latest_per_key,
    quality_report,
    upsert,
    upsert_where,
)
from tableflow.operators.skew import hot_values
from tableflow.plans.jobs import curate_plan, market_plan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"(?<![A-Za-z]){node}(?![A-Za-z])", plan(df)))


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "ticks")
    spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise((F.col("id") % 50).cast("string")).alias("symbol"),
        F.timestamp_seconds("id").alias("event_time"),
        (F.col("id") % 97).cast("double").alias("close"),
        F.col("id").alias("n"),
        F.lit("unused").alias("wide"),
    ).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_indicators_shuffle_and_sort_once(ticks):
    df = indicators(ticks, tiebreak=["n"])
    assert count(df, "Exchange") == 1 and count(df, "Sort") == 1 and count(df, "Window") == 2


def test_only_needed_columns_are_read(ticks):
    df = indicators(ticks, tiebreak=["n"]).select("symbol", "event_time", "rsi_14")
    assert "wide" not in plan(df)


def test_filter_on_the_series_reaches_the_files(ticks):
    df = indicators(ticks, tiebreak=["n"]).filter("symbol = 'HOT'")
    assert "EqualTo(symbol,HOT)" in plan(df)


def test_since_reaches_the_files(ticks):
    df = indicators(ticks, tiebreak=["n"], since="1970-01-01 05:00:00")
    assert "GreaterThanOrEqual(event_time" in plan(df)
    assert "WindowGroupLimit" in plan(df)


def test_segmented_history_is_limited_before_its_shuffle(ticks):
    text = plan(indicators(ticks, tiebreak=["n"], split=Split(rows_per_segment=500)))
    assert text.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_rank_limit_before_the_shuffle(ticks):
    for df in (
        latest_per_key(ticks, ["symbol"], "event_time", ["n"]),
        bollinger_latest(ticks, 20, tiebreak=["n"]),
        curate_plan(
            ticks, keys=["symbol"], order_by="event_time", tiebreak=["n"], required=[], types={}
        ),
    ):
        assert count(df, "WindowGroupLimit") == 2 and count(df, "Exchange") == 1


def test_bars_combine_before_the_shuffle(ticks):
    df = bars(ticks, "1 hour", tiebreak=[])
    assert count(df, "HashAggregate") == 2 and count(df, "Exchange") == 1


def test_distinct_combines_before_the_shuffle(ticks):
    df = clean_distinct(ticks)
    assert count(df, "HashAggregate") == 2 and count(df, "Exchange") == 1


def test_report_is_one_scan(ticks):
    df = quality_report(ticks, required=["symbol"], prices=["close"], complete=["symbol", "close"])
    assert count(df, "FileScan") == 1


def test_market_plan_has_one_shuffle(ticks):
    assert count(market_plan(ticks, tiebreak=["n"]), "Exchange") == 1


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 40])
def test_no_nested_loops_in_upserts(ticks, broadcast_bytes):
    source = ticks.groupBy("symbol").agg(F.max("close").alias("close"))
    one = upsert(
        ticks,
        source,
        on=["symbol"],
        set={"close": "close"},
        insert={"symbol": "symbol"},
        broadcast_bytes=broadcast_bytes,
    )
    two = upsert_where(
        ticks,
        source,
        on=[("symbol", "symbol")],
        condition=F.col("target.close") < F.col("source.close"),
        target_id=["n"],
        set={"close": "close"},
        insert={"symbol": "symbol"},
        broadcast_bytes=broadcast_bytes,
    )
    for df in (one, two):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small_partitions(spark):
    """Sizes at which the small tables here count as skewed."""
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return plan(df)


def test_hot_key_of_an_upsert_is_not_shuffled(ticks, small_partitions):
    source = ticks.groupBy("symbol").agg(F.max("close").alias("close"))
    rule = HotKeys(min_rows=5_000, sample_fraction=0.5)
    hot = hot_values([ticks, source], ["symbol"], rule)
    assert [r.symbol for r in hot.collect()] == ["HOT"]
    merged = upsert(
        ticks,
        source,
        on=["symbol"],
        set={"close": "close"},
        insert={"symbol": "symbol"},
        hot=rule,
        broadcast_bytes=0,
    )
    # One full outer join of what is left without hot keys; all other joins are broadcasts.
    assert count(merged, "SortMergeJoin") == 1
    assert merged.count() == 20_000


def test_large_upsert_shuffles_each_side_once(ticks, small_partitions):
    source = ticks.select("n", (F.col("close") + 1).alias("close"))
    merged = upsert(
        ticks,
        source,
        on=["n"],
        set={"close": "close"},
        insert={"n": "n"},
        hot=None,
        broadcast_bytes=0,
    )
    assert count(merged, "SortMergeJoin") == 1
    assert count(merged, "Exchange") == 2


def test_condition_upsert_evaluates_its_source_once(spark, ticks, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = ticks.filter("n < 50").select("symbol", "close", "n").mapInArrow(note, "symbol string, close double, n bigint")
    upsert_where(
        ticks,
        source,
        on=[("n", "n")],
        condition=F.col("target.close") <= F.col("source.close"),
        target_id=["n"],
        set={"close": "close"},
        insert={"symbol": "symbol"},
        broadcast_bytes=0,
    ).collect()
    assert seen.value == 50


def test_hot_key_of_a_condition_upsert_is_split(ticks, small_partitions):
    """A target key with a third of the rows is read by several tasks of the inner join."""
    source = ticks.filter("n < 200").select("symbol", "close", F.col("n").alias("seq"))
    matched = upsert_where(
        ticks,
        source,
        on=[("symbol", "symbol")],
        condition=(F.col("target.n") >= F.col("source.seq") * 2)
        & (F.col("target.n") < F.col("source.seq") * 2 + 1),
        target_id=["n"],
        set={"close": "close"},
        insert={"symbol": "symbol"},
        broadcast_bytes=0,
    )
    assert "skew=true" in final_plan(matched)


def test_small_source_leaves_the_target_unshuffled(ticks, small_partitions):
    source = ticks.filter("n < 100").select("n", (F.col("close") + 1).alias("close"))
    merged = upsert(ticks, source, on=["n"], set={"close": "close"}, insert={"n": "n"})
    assert count(merged, "SortMergeJoin") == 0
    assert "RoundRobin" not in plan(merged)
    # Only source keys, and the target keys found among them, are shuffled.
    assert count(merged, "Exchange") == 3
    assert merged.count() == 20_000
