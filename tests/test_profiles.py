"""Profiles merged from parts equal profiles of the whole; sketches stay within their errors."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableflow import ContractError, merge_profiles, null_nan_profile, profile_drift, profile_state, read_profile

NAN = float("nan")


def table(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice("abc"), rng.choice([None, NAN, rng.gauss(0, 1), rng.gauss(0, 1)]), rng.choice([None, f"s{rng.randrange(700)}"]), [i % 5])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, part string, x double, name string, list array<int>")


def exact(states):
    names = ["column", "type", "rows", "nulls", "nans", "low", "high"]
    return sorted((tuple(r) for r in states.select(names).collect()), key=repr)


def test_merged_parts_equal_the_whole(spark):
    df = table(spark)
    whole = profile_state(df, ["id", "x", "name", "list"])
    parts = profile_state(df, by=["part"])
    assert parts.count() == 12 and exact(merge_profiles(parts)) == exact(whole)
    counts = {r["column"]: (r["rows"], r["nulls"], r["nans"]) for r in null_nan_profile(df).collect()}
    assert {r["column"]: (r["rows"], r["nulls"], r["nans"]) for r in merge_profiles(parts).collect()} == {
        k: v for k, v in counts.items() if k != "part"
    }
    again = merge_profiles(merge_profiles(parts, by=["part"]))
    assert exact(again) == exact(whole)


def test_sketches_are_within_their_errors(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 10).alias("part"), F.col("id").cast("double").alias("x"), (F.col("id") % 30_000).cast("string").alias("name")
    )
    found = {r["column"]: r for r in read_profile(merge_profiles(profile_state(df, by=["part"])), [0.1, 0.5, 0.99]).collect()}
    assert found["name"]["quantiles"] is None and abs(found["name"]["distinct"] / 30_000 - 1) < 0.06
    assert abs(found["x"]["distinct"] / 200_000 - 1) < 0.06
    for share, value in zip([0.1, 0.5, 0.99], found["x"]["quantiles"], strict=True):
        assert abs(value / 200_000 - share) < 0.03


def test_a_changed_part_is_profiled_alone(spark):
    df = table(spark)
    changed = df.where("NOT (part = 'b' AND id % 2 = 0)")
    kept = profile_state(df, by=["part"]).where("part <> 'b'")
    anew = profile_state(changed.where("part = 'b'"), by=["part"])
    assert exact(merge_profiles(kept.unionByName(anew))) == exact(profile_state(changed, ["id", "x", "name", "list"]))


def test_empty_and_all_null(spark):
    df = table(spark).select("id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("name"))
    empty = merge_profiles(profile_state(df.limit(0)))
    assert [r[2:] for r in exact(empty)] == [(0, 0, 0, None, None)] * 3
    assert profile_state(df.limit(0).withColumn("part", F.lit(1)), by=["part"]).count() == 0
    found = {r["column"]: r for r in read_profile(profile_state(df)).collect()}
    assert (found["x"]["distinct"], found["x"]["quantiles"], found["x"]["nulls"]) == (0, None, 4000)
    drift = profile_drift(empty, merge_profiles(profile_state(df)))
    assert {r["column"]: r["reasons"] for r in drift.collect()} == {"id": [], "x": [], "name": []}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 2.0, "a.b")], "`rows` long, `column` double, `a.b` string")
    assert [r[:3] for r in exact(profile_state(df))] == [("a.b", "string", 1), ("column", "double", 1), ("rows", "bigint", 1)]
    with pytest.raises(ContractError, match="named like"):
        profile_state(df, by=["rows"])
    with pytest.raises(ContractError, match="no column"):
        profile_state(df, [])
    with pytest.raises(ContractError):
        profile_state(df, ["absent"])


def reasons(before, after):
    drift = profile_drift(merge_profiles(profile_state(before)), merge_profiles(profile_state(after)))
    return {(r["column"], r["type"]): r["reasons"] for r in drift.collect()}


def test_drift(spark):
    before = table(spark).drop("list", "part").withColumn("gone", F.lit(1))
    same = reasons(before, table(spark, 8000, seed=2).drop("list", "part", "name").join(before.select("id", "name", "gone"), "id", "left"))
    assert same[("x", "double")] == [] and same[("gone", "int")] == ["nulls"]
    after = before.select(
        F.col("id").cast("int").alias("id"),
        F.when(F.col("id") % 3 > 0, F.col("x") + 0.5).alias("x"),
        F.col("id").cast("string").alias("name"),
    )
    found = reasons(before, after)
    assert found == {
        ("id", "bigint"): ["removed"],
        ("id", "int"): ["added"],
        ("gone", "int"): ["removed"],
        ("x", "double"): ["nulls", "nans", "values"],
        ("name", "string"): ["nulls", "distinct"],
    }


def test_distance_of_distributions(spark):
    low = spark.range(50_000).select((F.col("id") % 1000).cast("double").alias("x"))
    states = [merge_profiles(profile_state(df)) for df in (low, low.select((F.col("x") + 300).alias("x")))]
    assert abs(profile_drift(*states).first()["rank_distance"] - 0.3) < 0.05
    two = spark.range(1000).select((F.col("id") % 2).alias("x")), spark.range(1000).select(F.expr("CAST(id % 4 = 0 AS bigint)").alias("x"))
    assert abs(profile_drift(*(profile_state(df) for df in two)).first()["rank_distance"] - 0.25) < 0.05


def test_states_of_parts_are_not_compared(spark):
    parts = profile_state(table(spark), by=["part"])
    with pytest.raises(PySparkException, match="Merge the states first"):
        profile_drift(parts, merge_profiles(parts)).collect()


def test_states_are_combined_in_the_map_tasks(spark):
    plan = profile_state(table(spark).repartition(3), by=["part"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg_double" in plan and "partial_hll_sketch_agg" in plan and plan.count("hashpartitioning") == 1
