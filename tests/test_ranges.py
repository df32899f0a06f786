"""Joins of points to ranges, and upserts on a range, against plain models."""

import datetime as dt
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableflow import RangeSplit, interval_join, scratch_scope, upsert_range
from tableflow.operators import ranges
from tableflow.operators.ranges import range_pairs

SMALL = RangeSplit(rows_per_bin=7, rows_per_task=15, max_bins=40, sample_fraction=1.0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def holds(point, low, high, included):
    if any(x is None or (isinstance(x, float) and math.isnan(x)) for x in (point, low, high)):
        return False
    above = point >= low if included in ("low", "both") else point > low
    return above and (point <= high if included in ("high", "both") else point < high)


def pairs_of(points, spans, included="low"):
    return sorted((i, j) for i, p in points for j, a, b in spans if holds(p, a, b, included))


def joined(spark, points, spans, kind, split=SMALL, **more):
    left = spark.createDataFrame(points, f"i int, p {kind}").repartition(3)
    right = spark.createDataFrame(spans, f"j int, a {kind}, b {kind}")
    out = interval_join(left, right, point="p", low="a", high="b", split=split, **more)
    assert out.columns == ["i", "p", "j", "a", "b"]
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    return sorted((r["i"], r["j"]) for r in out.select("i", "j").collect())


@pytest.mark.parametrize("included", ["low", "high", "both", "neither"])
def test_numbers_against_a_model(spark, included):
    rng = random.Random(1)
    points = [(i, rng.choice([None, rng.randrange(100), rng.randrange(20)])) for i in range(200)]
    spans = [(j, a := rng.randrange(110) - 5, a + rng.choice([-2, 0, 1, 3, 60])) for j in range(60)]
    spans += [(100, None, 5), (101, 5, None), (102, -(2**40), 2**40)]
    assert joined(spark, points, spans, "bigint", included=included) == pairs_of(points, spans, included)


def test_other_types(spark):
    nan, inf = float("nan"), float("inf")
    points = [(0, nan), (1, inf), (2, -inf), (3, 0.0), (4, -0.0), (5, 1e300), (6, None)]
    spans = [(0, -inf, inf), (1, 0.0, nan), (2, nan, 1.0), (3, -1.0, 1.0), (4, 0.0, 1e301)]
    assert joined(spark, points, spans, "double", included="both") == pairs_of(points, spans, "both")
    day = [dt.date(2024, 2, 26) + dt.timedelta(days=i) for i in range(40)]
    points, spans = list(enumerate(day)), [(0, day[3], day[9]), (1, day[0], day[39]), (2, day[39], day[39])]
    assert joined(spark, points, spans, "date", included="both") == pairs_of(points, spans, "both")
    for kind in ("timestamp", "timestamp_ntz"):
        time = [dt.datetime(1969, 12, 31, 23, 59, 59, 999_000) + dt.timedelta(milliseconds=i * 333) for i in range(60)]
        points, spans = list(enumerate(time)), [(j, time[j], time[j + 5]) for j in range(50)]
        assert joined(spark, points, spans, kind) == pairs_of(points, spans)


def test_one_instant_and_many_overlapping_ranges_are_split(spark):
    points = [(i, 50 if i < 150 else i) for i in range(250)]
    spans = [(j, 40, 60) for j in range(80)] + [(100 + j, j * 2, j * 2 + 2) for j in range(100)]
    left = spark.createDataFrame(points, "i int, p int")
    right = spark.createDataFrame(spans, "j int, a int, b int")
    with scratch_scope(spark):
        pairs = range_pairs(left, right, point="p", low="a", high="b", split=SMALL).pairs
        share = [F.col(f"target.{c}") for c in ("__bin", "__share_of_points", "__share_of_ranges")]
        tasks = pairs.groupBy(*share).agg(F.countDistinct("i").alias("points"), F.countDistinct("j").alias("ranges"))
        most = tasks.agg(F.max("points").alias("p"), F.max("ranges").alias("r")).first()
        assert most["p"] <= 2 * SMALL.rows_per_task and most["r"] <= 2 * SMALL.rows_per_task
        assert tasks.where("__share_of_points > 0").count() and tasks.where("__share_of_ranges > 0").count()
        found = sorted((r["i"], r["j"]) for r in pairs.select("i", "j").collect())
    assert found == pairs_of(points, spans)


def test_cut_points_are_even(spark):
    rows = spark.range(30_000).withColumn("x", F.col("id") * F.col("id") / 1e6)
    cuts = ranges._cut_points(rows, F.col("x"), RangeSplit(rows_per_bin=1_000))
    assert 28 <= len(cuts) <= 30 and cuts == sorted(cuts)
    sizes = rows.groupBy(ranges._bin_of(F.col("x"), cuts).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 1_500
    few = ranges._cut_points(rows.limit(500), F.col("x"), RangeSplit())
    assert few == []


def test_empty_sides_and_wrong_arguments(spark):
    points = spark.createDataFrame([(1, 5)], "i int, p int")
    spans = spark.createDataFrame([(1, 0, 9)], "j int, a int, b int")
    rule = {"point": "p", "low": "a", "high": "b"}
    assert interval_join(points.limit(0), spans, **rule).count() == 0
    assert interval_join(points, spans.limit(0), **rule).count() == 0
    assert interval_join(points, spans, **rule, condition=F.col("source.j") > 1).count() == 0
    for wrong in ({"included": "all"}, {"point": "q"}, {"low": "q"}):
        with pytest.raises(ValueError):
            interval_join(points, spans, **(rule | wrong))
    for kind in ("string", "date"):
        with pytest.raises(ValueError):
            interval_join(points.withColumn("p", F.lit(None).cast(kind)), spans, **rule)
    with pytest.raises(ValueError):
        RangeSplit(rows_per_bin=0)


TARGET = "id int, t int, v double, note string"


def ranged(target, source, **more):
    rule = {"point": "t", "low": "a", "high": "b", "target_id": ["id"], "split": SMALL}
    values = {"set": {"v": "v"}, "insert": {"id": F.lit(-1), "t": "a", "v": "v"}}
    return upsert_range(target, source, **(rule | values | more))


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_upsert_against_a_model(spark, broadcast_bytes):
    rng = random.Random(3)
    target = [(i, rng.choice([None, rng.randrange(200), 77]), float(i), "kept") for i in range(150)]
    source = [(a, a + rng.randrange(6), -float(a)) for a in range(0, 220, 6)] + [(None, 9, 1.0), (9, 3, 2.0), (9, 3, 2.0)]
    out = ranged(
        spark.createDataFrame(target, TARGET),
        spark.createDataFrame(source, "a int, b int, v double"),
        broadcast_bytes=broadcast_bytes,
    )
    expected = []
    for i, t, v, note in target:
        hit = [s for s in source if holds(t, s[0], s[1], "low")]
        expected.append((i, t, hit[0][2] if hit else v, note))
    expected += [(-1, a, v, None) for a, b, v in source if not any(holds(t[1], a, b, "low") for t in target)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)


def test_upsert_with_a_condition_and_two_hits(spark):
    target = spark.createDataFrame([(1, 5, 1.0, "x"), (2, 6, 9.0, "y")], TARGET)
    source = spark.createDataFrame([(0, 9, 4.0), (5, 9, 5.0)], "a int, b int, v double")
    with pytest.raises(PySparkException, match="Several source rows"):
        ranged(target, source).collect()
    low = F.col("target.v") < F.col("source.v")
    out = ranged(target, source.where("a = 0"), condition=low)
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, 5, 4.0), (2, 6, 9.0)]
    with pytest.raises(ValueError):
        ranged(target, source, target_id=[])


def test_scope_drops_what_was_written(spark):
    target = spark.createDataFrame([(1, 5, 1.0, "x")], TARGET)
    source = spark.createDataFrame([(0, 9, 4.0)], "a int, b int, v double")
    with scratch_scope(spark) as outer:
        with pytest.raises(RuntimeError), scratch_scope(spark) as inner:
            ranged(target, source).collect()
            raise RuntimeError
        assert inner and not outer
        ranged(target, source).collect()
    for path in (*inner, *outer):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
