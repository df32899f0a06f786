"""Bars that are merged and rolled up equal bars of all ticks."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableflow import bar_states, bars, copy_columns, merge_rule, roll_up, upsert, without_state

RULE = {"tiebreak": ["id"], "volume": "size"}


def ticks(spark, seed, n=600):
    rng = random.Random(seed)
    rows = [
        (rng.choice("ab"), rng.choice([rng.randrange(200_000), 7_200]) if i % 30 else None, rng.choice([float(rng.randrange(50)), None]),
         rng.choice([1.0, None]), i)
        for i in range(n)
    ]
    made = spark.createDataFrame(rows, "symbol string, s long, close double, size double, id int")
    return made.withColumn("s", F.timestamp_seconds("s")).withColumnRenamed("s", "event_time")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("parts", [2, 5])
def test_merged_and_rolled_up_equal_all_ticks(spark, parts):
    df = ticks(spark, parts)
    split = [df.where(F.col("id") % parts == k) for k in range(parts)]
    states = bar_states(split[0], "15 minutes", **RULE)
    for part in split[1:]:
        states = upsert(
            states, bar_states(part, "15 minutes", **RULE), on=["symbol", "event_time"], set=merge_rule(), insert=copy_columns(states.columns)
        )
    for interval in ("15 minutes", "1 hour", "1 day"):
        rolled = roll_up(states, interval)
        assert rows(without_state(rolled)) == rows(bars(df, interval, **RULE))
    twice = roll_up(roll_up(states, "1 hour"), "1 day")
    assert rows(twice) == rows(roll_up(states, "1 day"))


def test_tables_of_states_put_together(spark):
    df = ticks(spark, 9)
    halves = [bar_states(df.where(F.col("id") % 2 == k), "1 hour", **RULE) for k in (0, 1)]
    assert rows(without_state(roll_up(halves[0].unionByName(halves[1])))) == rows(bars(df, "1 hour", **RULE))


def test_bars_that_do_not_nest_fail(spark):
    states = bar_states(ticks(spark, 1), "45 minutes", **RULE)
    with pytest.raises(PySparkException, match="within one interval"):
        roll_up(states, "1 hour").collect()


def test_empty_table(spark):
    states = bar_states(ticks(spark, 1).limit(0), "1 hour", **RULE)
    assert roll_up(states, "1 day").count() == 0 and without_state(states).columns == bars(ticks(spark, 1), "1 hour", **RULE).columns


def test_rolling_up_combines_in_the_map_tasks(spark):
    plan = roll_up(bar_states(ticks(spark, 1), "1 hour", **RULE), "1 day")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "partial_sum" in plan
