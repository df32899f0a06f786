"""Contents of a written table are compared by fingerprints that do not depend on the order of rows."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tableflow import ContractError, reconcile_contents, write_and_verify

SCHEMA = "symbol string, id int, v double, at timestamp, n decimal(10,2), raw binary, tags array<string>, s struct<a:int,b:string>"


def rows(spark, n=40):
    made = [
        ("ab"[i % 2] if i % 9 else None, i % 13, [float("nan"), 0.1 * i, -0.0, None][i % 4], dt.datetime(2024, 1, 1, 0, 0, i), decimal.Decimal(i),
         bytes([i]), [str(i), None], (i, "x"))
        for i in range(n)
    ]
    return spark.createDataFrame(made, SCHEMA)


def ok(report):
    return {r["symbol"]: r["ok"] for r in report.collect()}


def test_same_rows_in_any_order(spark, tmp_path):
    df = rows(spark)
    report, whole = write_and_verify(df, f"{tmp_path}/out")
    assert whole and ok(report) == {"a": True, "b": True, None: True}
    assert all(ok(reconcile_contents(df, df.repartition(5).orderBy(F.rand(3)), "symbol")).values())


@pytest.mark.parametrize(
    "change",
    [
        lambda df: df.withColumn("v", F.when(F.col("n") == 5, F.col("v") + 1e-12).otherwise(F.col("v"))),
        lambda df: df.withColumn("id", F.when(F.col("n") == 3, 5).when(F.col("n") == 5, 3).otherwise(F.col("id"))),
        lambda df: df.withColumn("tags", F.when(F.col("n") == 3, F.array(F.lit("3"))).otherwise(F.col("tags"))),
        lambda df: df.withColumn("raw", F.when(F.col("n") == 3, F.lit(None)).otherwise(F.col("raw"))),
        lambda df: df.where("n <> 3").unionByName(df.where("n = 5")),
        lambda df: df.where("n <> 3"),
    ],
)
def test_changes_are_found_where_they_are(spark, change):
    df = rows(spark)
    got = ok(reconcile_contents(df, change(df), "symbol"))
    assert got == {"a": True, "b": False, None: True}


def test_values_swapped_between_rows_with_equal_counts(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "symbol string, id int, v double")
    swapped = spark.createDataFrame([("a", 1, 20.0), ("a", 2, 10.0)], "symbol string, id int, v double")
    row = reconcile_contents(df, swapped, "symbol").first()
    assert row["rows_sent"] == row["rows_read"] == 2 and not row["ok"]


def test_text_that_runs_over_a_border(spark):
    schema = "symbol string, x string, y string"
    one, other = ([("a", "p", "qr")], [("a", "pq", "r")])
    assert ok(reconcile_contents(spark.createDataFrame(one, schema), spark.createDataFrame(other, schema), "symbol")) == {"a": False}


def test_empty_tables_missing_columns_and_maps(spark, tmp_path):
    df = rows(spark)
    assert reconcile_contents(df.limit(0), df.limit(0), "symbol").count() == 0
    assert ok(reconcile_contents(df.where("symbol = 'a'"), df.limit(0), "symbol")) == {"a": False}
    with pytest.raises(ValueError):
        reconcile_contents(df, df.drop("v"), "symbol")
    with pytest.raises(ContractError):
        write_and_verify(df.withColumn("m", F.create_map(F.lit(1), F.lit(2))), f"{tmp_path}/out")
