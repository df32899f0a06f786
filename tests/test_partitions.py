"""Upserts that replace touched partitions only, and CSV streams that bind by name."""

import os

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from tableflow import ContractError, copy_columns, read_stream, run_to_end, start_append, upsert_partitions, write_partitioned
from tableflow.sources import partitions

SCHEMA = "id bigint, day string, v double"


def files(path):
    return {
        os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def put(spark, path, rows, **more):
    how = {
        "schema": SCHEMA, "partition_by": "day", "on": ["day", "id"], "set": {"v": "v"}, "insert": copy_columns(["id", "v"]) | {"day": "day"},
    }
    return upsert_partitions(spark, path, spark.createDataFrame(rows, SCHEMA), **(how | more))


@pytest.fixture
def stored(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = [(i, day, float(i)) for i, day in enumerate(["01", "01", "02", "03", None, None, "a/b=c"])]
    write_partitioned(spark.createDataFrame(rows, SCHEMA), path, "day")
    return path, rows


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("listed", [10_000, 0])
def test_only_touched_partitions_are_rewritten(spark, stored, listed, monkeypatch):
    path, rows = stored
    monkeypatch.setattr(partitions, "BROADCAST_VALUES", listed)
    before = files(path)
    out = put(spark, path, [(0, "01", -1.0), (2, "01", 7.0), (9, "04", 9.0), (6, "a/b=c", 0.0)])
    expected = [(0, "01", -1.0), *rows[1:6], (6, "a/b=c", 0.0), (2, "01", 7.0), (9, "04", 9.0)]
    assert got(out) == sorted(expected, key=str)
    after = files(path)
    untouched = {f: t for f, t in before.items() if f.startswith(("day=02", "day=03", "day=__HIVE"))}
    assert len(untouched) == 3 and untouched.items() <= after.items()
    assert not any(f in after for f in before if f.startswith(("day=01", "day=a")))


def test_rows_without_a_partition_value(spark, stored):
    path, rows = stored
    assert got(put(spark, path, [(4, None, -4.0)])) == sorted([*rows, (4, None, -4.0)], key=str)


def test_a_failed_upsert_and_an_empty_source_leave_the_table_as_it_is(spark, stored):
    path, rows = stored
    before = files(path)
    with pytest.raises(PySparkException, match="Several source rows"):
        put(spark, path, [(0, "01", 1.0), (0, "01", 2.0)])
    assert got(put(spark, path, [])) == sorted(rows, key=str)
    assert files(path) == before


def test_refused_arguments(spark, stored, tmp_path):
    path, _ = stored
    row = [(1, "01", 1.0)]
    for wrong in (
        {"on": ["id"]}, {"set": {"day": "day"}}, {"insert": {"id": "id"}}, {"insert": {"id": "id", "day": F.lit("05")}},
        {"partition_by": "v", "on": ["v"], "set": {"day": "day"}, "insert": copy_columns(["id", "day", "v"])},
    ):
        with pytest.raises(ValueError):
            put(spark, path, row, **wrong)
    with pytest.raises(ValueError):
        put(spark, f"{tmp_path}/nothing", row)


def stream_csv(spark, folder, schema="symbol string, close double"):
    query = start_append(read_stream(spark, f"{folder}/in", schema, "csv"), f"{folder}/out", f"{folder}/log", available_now=True)
    run_to_end(query, 60)
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{folder}/out").collect()), key=str)


def land(folder, name, text):
    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}", "w") as file:
        file.write(text)


def test_csv_stream_binds_by_name(spark, tmp_path):
    land(tmp_path, "a.csv", "close,extra,symbol\n5.0,x,BTC\n")
    land(tmp_path, "b.csv", "close,extra,symbol\n6.0,y,ETH\n")
    assert stream_csv(spark, tmp_path) == [("BTC", 5.0), ("ETH", 6.0)]


def test_csv_stream_without_a_declared_column_raises(spark, tmp_path):
    land(tmp_path, "a.csv", "price,symbol\n5.0,BTC\n")
    with pytest.raises(ContractError, match="close"):
        read_stream(spark, f"{tmp_path}/in", "symbol string, close double", "csv")


def test_csv_stream_fails_at_another_header(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    stream = read_stream(spark, f"{tmp_path}/in", "symbol string, close double", "csv")
    land(tmp_path, "a.csv", "close,symbol\n5.0,BTC\n")
    query = start_append(stream, f"{tmp_path}/out", f"{tmp_path}/log", available_now=True)
    with pytest.raises(StreamingQueryException):
        run_to_end(query, 60)
    assert not [f for f in files(f"{tmp_path}/out")]
