"""Latest per key, distinct, contracts and reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow import (
    ContractError,
    clean_distinct,
    has_columns,
    latest_per_key,
    null_nan_profile,
    quality_report,
    require_clean,
    require_columns,
    require_no_nan,
    require_schema,
    require_types,
)


def test_latest_keeps_newest(spark):
    rows = [("1", "2026-01-01", 10), ("1", "2026-01-02", 20), ("2", "2026-01-01", 30)]
    df = spark.createDataFrame(rows, "id string, updated_at string, value bigint")
    out = latest_per_key(df, ["id"], "updated_at", [])
    assert sorted(tuple(r) for r in out.collect()) == [
        ("1", "2026-01-02", 20),
        ("2", "2026-01-01", 30),
    ]
    assert out.columns == df.columns


def test_ties_nulls_and_null_keys(spark):
    when = datetime(2026, 1, 1)
    rows = [
        ("a", when, 1),
        ("a", when, 3),
        ("a", when, 2),
        ("b", None, 9),
        ("b", when, 1),
        (None, when, 1),
        (None, when, 2),
    ]
    df = spark.createDataFrame(rows, "id string, at timestamp, n int")
    for parts in (1, 4):
        out = latest_per_key(df.repartition(parts), ["id"], "at", ["n"]).collect()
        assert {(r.id, r.n) for r in out} == {("a", 3), ("b", 1), (None, 2)}


def test_latest_equals_max_by(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 101).alias("at"),
        "id",
    )
    found = latest_per_key(df, ["k"], "at", ["id"])
    expected = df.groupBy("k").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
    assert {(r.k, r.id) for r in found.collect()} == {(r.k, r.id) for r in expected.collect()}


def test_latest_needs_keys(spark):
    with pytest.raises(ValueError, match="keys is empty"):
        latest_per_key(spark.range(1), [], "id", [])


def test_clean_distinct(spark):
    df = spark.createDataFrame([("a ", 1), (" a", 1), ("a", 2), (None, 1), (None, 1)], "s string, n int")
    assert sorted(map(tuple, clean_distinct(df).collect()), key=str) == [
        ("a", 1),
        ("a", 2),
        (None, 1),
    ]


def test_clean_distinct_refuses_maps(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    with pytest.raises(ContractError, match="MAP"):
        clean_distinct(df)


def test_required_columns(spark):
    df = spark.createDataFrame([("1",)], "id string")
    assert require_columns(df, ["id"]) is df
    assert has_columns(df, ["id"]) and has_columns(df, []) and not has_columns(df, ["ID"])
    with pytest.raises(ContractError, match=r"\['value', 'ID'\]"):
        require_columns(df, ["id", "value", "ID"])


def test_exact_schema(spark):
    df = spark.createDataFrame([("1", 10.0)], "id string, value double")
    same = [T.StructField("id", T.StringType()), T.StructField("value", T.DoubleType())]
    require_schema(df, T.StructType(same))
    for other in (
        [T.StructField("value", T.DoubleType()), T.StructField("id", T.StringType())],
        [T.StructField("id", T.StringType(), False), T.StructField("value", T.DoubleType())],
        [T.StructField("id", T.StringType())],
    ):
        with pytest.raises(ContractError, match="Schema mismatch"):
            require_schema(df, T.StructType(other))


def test_types_report_all_mismatches(spark):
    df = spark.createDataFrame([("1", 10.0)], "id string, price double")
    require_types(df, {"id": "string"})
    with pytest.raises(ContractError) as error:
        require_types(df, {"id": "bigint", "price": "decimal", "absent": "int", "ID": "string"})
    for part in ("id is string", "price is double", "absent is absent", "ID is absent"):
        assert part in str(error.value)
    require_types(df, {"id": "STRING"}, case_sensitive=False)
    with pytest.raises(ContractError):
        require_types(df, {"id": "STRING"})


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, float("nan"), None), (None, None, None)], "i int, x double, `s.t` string"
    )
    found = {r["column"]: (r["rows"], r.nulls, r.nans) for r in null_nan_profile(df).collect()}
    assert found == {"i": (3, 1, 0), "x": (3, 1, 1), "s.t": (3, 2, 0)}
    require_no_nan(df, ["i"])
    with pytest.raises(ContractError, match="NaN"):
        require_no_nan(df, ["x"])


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert tuple(null_nan_profile(df).first()) == ("x", 0, 0, 0)


def test_quality_report(spark):
    df = spark.createDataFrame([("a", 1.0), (None, -1.0), ("b", float("nan"))], "k string, p double")
    report = quality_report(
        df, required=["k", "z"], types={"p": "double", "k": "int"}, prices=["p"], complete=["k"]
    )
    found = {(r.check, r.column): (r.actual, r.violations) for r in report.collect()}
    assert found == {
        ("required", "k"): ("present", 0),
        ("required", "z"): ("missing", 1),
        ("type", "p"): ("double", 0),
        ("type", "k"): ("string", 1),
        ("valid_price", "p"): (None, 2),
        ("complete", "k"): (None, 1),
        ("nan", "p"): (None, 1),
    }
    with pytest.raises(ContractError, match="missing"):
        require_clean(report)
    require_clean(quality_report(df, required=["k"], types={"k": "string"}).filter("check <> 'nan'"))


def test_empty_report(spark):
    assert quality_report(spark.createDataFrame([("a",)], "k string")).count() == 0
