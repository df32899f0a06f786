"""Late and corrected ticks: a repaired indicator table equals one computed anew, and little of it is rewritten."""

import random

import pytest
from pyspark.sql import functions as F

from tableflow import Split, indicators, repair_indicators, replace_rows
from tableflow.operators.indicators import INDICATOR_HISTORY

SCHEMA = "symbol string, event_time timestamp, close double, id int, volume int"
IDS = ["symbol", "event_time", "id"]


def ticks(spark, rows):
    made = spark.createDataFrame(rows, "symbol string, s long, close double, id int, volume int")
    return made.withColumn("s", F.timestamp_seconds("s")).withColumnRenamed("s", "event_time")


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def stored_table(df, path, split=None):
    indicators(df, tiebreak=["id"], split=split).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def random_rows(rng, n, symbols="abc", spread=60_000):
    return [
        (rng.choice(symbols), rng.choice([rng.randrange(spread), None if i % 40 == 0 else 777]), rng.choice([rng.uniform(1, 9), None]), i, i)
        for i in range(n)
    ]


@pytest.mark.parametrize("bucket, split", [("1 second", None), ("10 minutes", None), ("1 hour", Split(rows_per_segment=50)), ("400 days", None)])
def test_repaired_equals_computed_anew(spark, tmp_path, bucket, split):
    rng = random.Random(7)
    all_rows = random_rows(rng, 700)
    late = {r[3] for r in rng.sample(all_rows, 9)}
    wrong = {r[3] for r in rng.sample(all_rows, 6)} - late
    before = [(s, t, -1.0 if i in wrong else c, i, v) for s, t, c, i, v in all_rows if i not in late]
    changes = [r for r in all_rows if r[3] in late | wrong] + [("new", 5, 1.0, 9_000, 1), ("a", None, 2.0, 9_001, 1)]
    stored = stored_table(ticks(spark, before), f"{tmp_path}/stored")
    repaired = repair_indicators(stored, ticks(spark, changes), tiebreak=["id"], bucket=bucket, split=split)
    repaired.write.parquet(f"{tmp_path}/repaired")
    repaired = spark.read.parquet(f"{tmp_path}/repaired")
    expected = indicators(ticks(spark, [r for r in all_rows if r[3] not in late | wrong] + changes), tiebreak=["id"])
    assert rows(replace_rows(stored, repaired, IDS)) == rows(expected)
    assert repaired.count() <= len(changes) * (INDICATOR_HISTORY + 1)


def test_only_rows_behind_a_change_are_rewritten_and_few_are_read(spark, tmp_path):
    plain = [(s, t * 60, float(t % 17), t, 1) for s in "ab" for t in range(3_000)]
    stored = stored_table(ticks(spark, plain), f"{tmp_path}/stored")
    changes = ticks(spark, [("a", 60_030, 3.0, 5_000, 1), ("a", 60 * 2_999 + 1, 3.0, 5_001, 1)])
    repaired = repair_indicators(stored, changes, tiebreak=["id"], bucket="1 hour")
    assert repaired.groupBy("symbol").count().collect() == [("a", INDICATOR_HISTORY + 1 + 1)]


def test_copies_of_one_instant_over_segments(spark, tmp_path):
    same = [("a", 100, float(i % 5), i, 1) for i in range(300)]
    stored = stored_table(ticks(spark, [r for r in same if r[3] != 120]), f"{tmp_path}/stored")
    change = ticks(spark, [r for r in same if r[3] == 120])
    repaired = repair_indicators(stored, change, tiebreak=["id"], split=Split(rows_per_segment=40))
    assert repaired.count() == INDICATOR_HISTORY + 1
    expected = indicators(ticks(spark, same), tiebreak=["id"])
    assert rows(replace_rows(stored, repaired, IDS)) == rows(expected)


def test_columns_that_changes_lack_and_empty_changes(spark, tmp_path):
    stored = stored_table(ticks(spark, [("a", t, 1.0, t, 5) for t in range(40)]), f"{tmp_path}/stored")
    none = ticks(spark, [("a", 0, 1.0, 0, 5)]).limit(0)
    assert repair_indicators(stored, none, tiebreak=["id"]).count() == 0
    changes = ticks(spark, [("a", 39, 2.0, 99, 5)]).drop("volume")
    row = repair_indicators(stored, changes, tiebreak=["id"]).collect()
    assert [(r["id"], r["volume"], r["close"]) for r in row] == [(99, None, 2.0)]
    with pytest.raises(ValueError):
        repair_indicators(stored.drop("macd"), changes, tiebreak=["id"])
    with pytest.raises(ValueError):
        repair_indicators(stored, changes.drop("close"), tiebreak=["id"])
