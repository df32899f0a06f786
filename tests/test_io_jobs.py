"""Sources, sinks and the batch jobs on files."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tableflow import (
    ContractError,
    Split,
    bronze_job,
    curate_job,
    drop_scratch,
    indicators,
    land_text,
    market_job,
    read_stream,
    read_table,
    read_version,
    reconcile,
    scratch_dir,
    upsert_table,
    write_and_reconcile,
    write_partitioned,
    write_table,
    write_version,
)
from tableflow.plans.jobs import curate_plan

TICKS = "symbol string, event_time string, close string"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_and_json(spark, tmp_path):
    csv = write_lines(tmp_path / "a.csv", ["id,at,v", "1,2026-01-01 00:00:00,2.5", "2,,"])
    lines = [json.dumps({"id": "1", "at": "2026-01-01 00:00:00", "v": 2.5}), json.dumps({"id": "2"})]
    jsonl = write_lines(tmp_path / "a.json", lines)
    schema = "id string, at timestamp_ntz, v double"
    expected = [("1", datetime(2026, 1, 1), 2.5), ("2", None, None)]
    for path, fmt in ((csv, "csv"), (jsonl, "json")):
        df = read_table(spark, path, fmt, schema, probe=True)
        assert sorted(map(tuple, df.collect())) == expected
    inferred = read_table(spark, csv, "csv", infer_schema=True)
    assert dict(inferred.dtypes) == {"id": "int", "at": "timestamp", "v": "double"}
    assert read_table(spark, jsonl, "json", infer_schema=True).columns == ["at", "id", "v"]


def test_reader_arguments(spark, folder):
    with pytest.raises(ValueError, match="Unsupported format"):
        read_table(spark, folder, "xml")
    with pytest.raises(ValueError, match="Declare a schema"):
        read_table(spark, folder, "csv")
    with pytest.raises(ValueError, match="Unsupported streaming format"):
        read_stream(spark, folder, "a int", "xml")


def test_fallback_only_for_a_missing_path(spark, tmp_path):
    there = write_lines(tmp_path / "a.csv", ["id", "1"])
    absent = str(tmp_path / "absent")
    assert read_table(spark, absent, "csv", "id int", fallback_path=there).count() == 1
    with pytest.raises(AnalysisException):
        read_table(spark, absent, "csv", "id int")
    with pytest.raises(AnalysisException):
        read_table(spark, there, "csv", "not a schema", fallback_path=there)


def test_orc_and_parquet(spark, folder):
    df = spark.range(3)
    for fmt in ("orc", "parquet"):
        write_table(df, f"{folder}/{fmt}", fmt=fmt)
        assert read_table(spark, f"{folder}/{fmt}", fmt).count() == 3


def test_append_and_overwrite(spark, folder):
    path = f"{folder}/t"
    df = spark.range(3).withColumn("p", F.lit("1"))
    write_table(df, path)
    write_table(df, path)
    assert spark.read.parquet(path).count() == 6
    write_table(df, path, mode="overwrite")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ContractError):
        write_table(df.withColumn("p", F.lit(1)), path)
    with pytest.raises(ContractError):
        write_table(df.withColumn("q", F.lit(1)), path)
    with pytest.raises(ContractError):
        write_table(df.drop("p"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="mode"):
        write_table(df, path, mode="ignore")


def test_append_to_a_partitioned_table(spark, folder):
    path = f"{folder}/t"
    df = spark.range(3).withColumn("p", F.lit("1"))
    write_table(df, path, partition_by="p")
    write_table(df, path, partition_by="p")
    back = read_table(spark, path, "parquet", df.schema)
    assert back.count() == 6 and {r.p for r in back.collect()} == {"1"}
    with pytest.raises(ContractError):
        write_table(df.withColumnRenamed("p", "q"), path, partition_by="q")
    with pytest.raises(ContractError, match=r"partitioned by \['p'\], not by \[\]"):
        write_table(df, path)
    write_table(df, f"{folder}/flat")
    with pytest.raises(ContractError, match=r"partitioned by \[\], not by \['p'\]"):
        write_table(df, f"{folder}/flat", partition_by="p")
    assert spark.read.parquet(path).count() == 6
    assert spark.read.parquet(f"{folder}/flat").count() == 3


def test_append_to_an_empty_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    write_table(spark.range(3), str(tmp_path / "t"))
    write_table(spark.range(0), str(tmp_path / "u"))
    write_table(spark.range(3), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3


def test_overwriting_the_input_is_refused(spark, folder):
    path = f"{folder}/t"
    write_table(spark.range(3).withColumn("symbol", F.lit("a")), path)
    stored = spark.read.parquet(path).filter("id > 0")
    for target in (path, f"file://{path}", folder):
        with pytest.raises(ValueError, match="read from"):
            write_table(stored, target, mode="overwrite")
        with pytest.raises(ValueError, match="read from"):
            write_partitioned(stored, target)
    assert spark.read.parquet(path).count() == 3
    write_table(stored, f"{path}2", mode="overwrite")
    write_table(stored, f"{path}2", mode="overwrite")


def test_partitioned_round_trip(spark, folder):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("symbol"),
        "id",
    )
    report, sent = write_and_reconcile(df.repartition(6), f"{folder}/b")
    lines = report.collect()
    assert sent == 1000 and sum(r.rows_read for r in lines) == 1000 and all(r.ok for r in lines)
    with pytest.raises(ContractError):
        write_partitioned(df.drop("symbol"), f"{folder}/c")


def test_reconcile_shows_losses(spark):
    sent = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "symbol string")
    stored = spark.createDataFrame([("a",), ("c",), (None,)], "symbol string")
    lines = {r.symbol: (r.rows_sent, r.rows_read, r.ok) for r in reconcile(sent, stored, "symbol").collect()}
    assert lines == {
        "a": (2, 1, False),
        "b": (1, 0, False),
        "c": (0, 1, False),
        None: (1, 1, True),
    }


def test_market_job(spark, tmp_path):
    lines = ["symbol,event_time,close"]
    for symbol, closes in {"BTC": (42000, 42150, 41980), "ETH": (2800, 2810, 2795)}.items():
        lines += [f"{symbol},2026-01-01 00:{5 * i:02}:00,{c}" for i, c in enumerate(closes)]
    path = write_lines(tmp_path / "ticks.csv", lines)
    out = market_job(
        spark, path, str(tmp_path / "out"), tiebreak=[], schema=TICKS, as_of="2026-02-01 00:00:00"
    )
    row = out.filter("symbol = 'BTC'").orderBy(F.desc("event_time")).first()
    assert row.moving_avg_14 == pytest.approx((42000 + 42150 + 41980) / 3)
    assert row.rsi_14 == pytest.approx(100 - 100 / (1 + 150 / 170))
    assert str(row.ingest_date) == "2026-02-01"
    assert out.count() == 6


def test_market_job_survives_bad_cells_but_not_bad_tables(spark, tmp_path):
    path = write_lines(
        tmp_path / "t.csv",
        ["symbol,event_time,close", "A,junk,1", "A,2026-01-01 00:00:00,abc", "A,2026-01-02,3"],
    )
    out = market_job(spark, path, str(tmp_path / "out"), tiebreak=[], schema=TICKS)
    found = {(r.event_time is None, r.close) for r in out.collect()}
    assert found == {(True, 1.0), (False, None), (False, 3.0)}
    with pytest.raises(ContractError, match="close"):
        market_job(
            spark, path, str(tmp_path / "o2"), tiebreak=[], schema="symbol string, event_time string"
        )
    with pytest.raises(ContractError, match="seq"):
        market_job(spark, path, str(tmp_path / "o3"), tiebreak=["seq"], schema=TICKS)


RAW = "id string, updated_at string, value bigint"


def test_curate_job(spark, tmp_path):
    rows = [
        {"id": " 1", "updated_at": "2026-01-01", "value": 10},
        {"id": "1 ", "updated_at": "2026-01-02", "value": 20},
        {"id": "1", "updated_at": "junk", "value": 99},
        {"id": "2", "updated_at": "2026-01-01", "value": 30},
        {"id": "2", "updated_at": "2026-01-01", "value": 30},
    ]
    path = write_lines(tmp_path / "r.json", [json.dumps(r) for r in rows])
    out = curate_job(spark, path, str(tmp_path / "out"), tiebreak=["value"], schema=RAW)
    assert sorted((r.id, r.value) for r in out.collect()) == [("1", 20), ("2", 30)]
    assert {"ingest_ts", "ingest_date"} <= set(out.columns)
    again = curate_job(spark, path, str(tmp_path / "out"), tiebreak=["value"], schema=RAW)
    assert again.count() == 2


def test_curate_equals_dropping_copies_first(spark):
    df = spark.range(3000).select(
        (F.col("id") % 40).cast("string").alias("id"),
        F.concat(F.lit("2026-01-0"), (F.col("id") % 9 + 1).cast("string")).alias("updated_at"),
        (F.col("id") % 13).alias("value"),
    )
    stamp = "2026-01-01 00:00:00"
    slim = curate_plan(df, tiebreak=["value"], as_of=stamp)
    full = curate_plan(df.dropDuplicates(), tiebreak=["value"], as_of=stamp)
    assert sorted(slim.collect()) == sorted(full.collect())


def test_curate_contract(spark, tmp_path):
    path = write_lines(tmp_path / "r.json", [json.dumps({"id": 1, "updated_at": "2026-01-01"})])
    bad = "id bigint, updated_at string"
    with pytest.raises(ContractError, match="Types differ"):
        curate_job(spark, path, str(tmp_path / "o"), tiebreak=[], schema=bad)
    with pytest.raises(ContractError, match="updated_at"):
        curate_job(spark, path, str(tmp_path / "o"), tiebreak=[], schema="id string")


def test_curate_casts_the_configured_order_column(spark):
    df = spark.createDataFrame([("1", "9"), ("1", "2026-01-01")], "id string, seen string")
    out = curate_plan(df, order_by="seen", tiebreak=[], required=["id"])
    assert dict(out.dtypes)["seen"] == "timestamp"


def test_bronze_job(spark, tmp_path):
    header = "symbol,event_time,open,high,low,close,volume"
    lines = [f"{s},2026-01-01 {h:02}:00:00,1,2,0.5,1.5,100" for s in ("1", "BTC") for h in range(10)]
    path = write_lines(tmp_path / "b.csv", [header, *lines, "BTC,junk,1,2,0.5,1.5,100"])
    schema = (
        "symbol string, event_time string, open double, high double, low double, close double, "
        "volume double"
    )
    report, sent = bronze_job(
        spark, str(tmp_path / "absent"), str(tmp_path / "out"), schema=schema, fallback_path=path
    )
    assert sent == 21
    assert {(r.symbol, r.rows_read, r.ok) for r in report.collect()} == {("1", 10, True), ("BTC", 11, True)}
    stored = read_table(
        spark, str(tmp_path / "out"), "parquet", schema.replace("event_time string", "event_time timestamp")
    )
    assert stored.filter("event_time is null").count() == 1
    assert stored.agg(F.min("close")).first()[0] > 0
    assert {r.symbol for r in stored.collect()} == {"1", "BTC"}


def test_scratch_dir_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(base + "/x-") and first != second


def test_errors_are_not_masked(spark, tmp_path):
    bad = tmp_path / "t"
    bad.mkdir()
    (bad / "a.parquet").write_text("no parquet file")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_table(spark, str(bad), "parquet", "a int", fallback_path=str(bad), probe=True)


def test_indicators_of_stored_table(spark, folder):
    ticks = spark.createDataFrame(
        [("A", datetime(2026, 1, 1, 0, i), float(i)) for i in range(5)],
        "symbol string, event_time timestamp_ntz, close double",
    )
    write_table(ticks, f"{folder}/t")
    assert indicators(spark.read.parquet(f"{folder}/t"), tiebreak=[]).count() == 5


# What is really in the files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def text_file(tmp_path, name, lines):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "part.txt").write_text("\n".join(lines) + "\n")
    return str(folder)


TICK_TEXT = "symbol string, event_time string, close string"


def test_csv_is_bound_by_name(spark, tmp_path):
    path = text_file(tmp_path, "in", ["close,extra,symbol,event_time", "5.0,x,A,2026-01-01 00:00:00"])
    assert rows(read_table(spark, path, "csv", TICK_TEXT)) == [("A", "2026-01-01 00:00:00", "5.0")]
    out = market_job(spark, path, str(tmp_path / "out"), tiebreak=[], schema=TICK_TEXT)
    row = out.first()
    assert (row.symbol, row.close, row.event_time) == ("A", 5.0, datetime(2026, 1, 1))


def test_absent_csv_column_raises(spark, tmp_path):
    path = text_file(tmp_path, "in", ["symbol,event_time", "A,2026-01-01 00:00:00"])
    for read in (
        lambda: read_table(spark, path, "csv", TICK_TEXT),
        lambda: market_job(spark, path, str(tmp_path / "out"), tiebreak=[], schema=TICK_TEXT),
    ):
        with pytest.raises(ContractError, match="close"):
            read()
    assert not (tmp_path / "out").exists()


def test_files_with_different_headers_fail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("symbol,event_time,close\nA,t,1\n")
    (tmp_path / "in" / "b.csv").write_text("close,event_time,symbol\n1,t,A\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path / "in"), "csv", TICK_TEXT).collect()


LINE_SCHEMA = "id string, updated_at string, n bigint"


def raw_lines():
    good = ['{"id": "a", "updated_at": "2026-01-01", "n": 1}', '{"n": 2, "id": "b"}']
    return [*good, "{broken", "[1, 2", '{"id": "c", "updated_at": "2026-01-01", "n": "no number"}', ""]


def test_broken_json_lines_are_counted_and_set_apart(spark, tmp_path):
    path, bad = text_file(tmp_path, "in", raw_lines()), str(tmp_path / "bad")
    with pytest.raises(ContractError, match="3 of 5 lines"):
        curate_job(spark, path, str(tmp_path / "out"), tiebreak=["n"], schema=LINE_SCHEMA)
    assert not (tmp_path / "out").exists()
    out = curate_job(spark, path, str(tmp_path / "out"), tiebreak=["n"], schema=LINE_SCHEMA, quarantine_path=bad)
    assert sorted(r.id for r in out.collect()) == ["a", "b"]
    assert sorted(r.line for r in spark.read.parquet(bad).collect()) == sorted(raw_lines()[2:5])


def test_json_field_that_no_line_holds_raises(spark, tmp_path):
    path = text_file(tmp_path, "in", ['{"id": "a", "n": 1}', '{"id": "b", "n": null}'])
    with pytest.raises(ContractError, match="updated_at"):
        land_text(spark, path, "json", LINE_SCHEMA)
    landed = land_text(spark, path, "json", "id string, n bigint")
    assert (landed.n_lines, landed.n_broken) == (2, 0)
    assert sorted(map(tuple, landed.rows.collect()), key=repr) == [("a", 1), ("b", None)]
    landed.drop()
    assert not Path(landed.path.removeprefix("file:")).exists()


def test_broken_csv_lines(spark, tmp_path):
    lines = ["id,updated_at,n", "a,t,1", "b,t", "c,t,3,4", "d,t,x", "e,,"]
    path, bad = text_file(tmp_path, "in", lines), str(tmp_path / "bad")
    landed = land_text(spark, path, "csv", LINE_SCHEMA, quarantine_path=bad)
    assert (landed.n_lines, landed.n_broken) == (5, 3)
    assert sorted(map(tuple, landed.rows.collect()), key=repr) == [("a", "t", 1), ("e", None, None)]
    assert sorted(r.line for r in landed.broken.collect()) == ["b,t", "c,t,3,4", "d,t,x"]
    land_text(spark, path, "csv", LINE_SCHEMA, quarantine_path=bad)
    assert spark.read.parquet(bad).count() == 6


def test_empty_files_land_as_empty_tables(spark, tmp_path):
    for fmt, lines in (("csv", ["id,updated_at,n"]), ("json", [])):
        landed = land_text(spark, text_file(tmp_path, fmt, lines), fmt, LINE_SCHEMA)
        assert landed.rows.count() == 0 and landed.rows.columns == ["id", "updated_at", "n"]


def test_market_job_parses_its_text_once(spark, tmp_path, monkeypatch):
    lines = ["symbol,event_time,close"] + [f"A,2026-01-01 00:00:{i:02d},{i}" for i in range(50)]
    path = text_file(tmp_path, "in", lines)
    reads = []
    original = type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, *a, **k: reads.append(a) or original(self, *a, **k))
    split = Split(rows_per_segment=10)
    out = market_job(spark, path, str(tmp_path / "out"), tiebreak=[], schema=TICK_TEXT, split=split)
    assert out.count() == 50
    # the header, and the one parse that lands the rows
    assert len(reads) == 2


def test_stored_table_is_upserted_in_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    start = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    with pytest.raises(ValueError, match="No complete version"):
        upsert_table(root, start, on=["id"], set={"v": "v"}, insert={"id": "id", "v": "v"})
    assert write_version(start, root) == 0
    source = spark.createDataFrame([(2, "x"), (3, "y"), (None, "m")], "id long, v string")
    rule = {"on": ["id"], "set": {"v": "v"}, "insert": {"id": "id", "v": "v"}}
    out = upsert_table(root, source, **rule)
    expected = sorted([(1, "a"), (2, "x"), (None, "n"), (3, "y"), (None, "m")], key=repr)
    assert rows(out) == expected == rows(read_version(spark, root))
    upsert_table(root, spark.createDataFrame([(9, "z")], "id long, v string"), broadcast_bytes=0, **rule)
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["version=1", "version=2"]
    assert rows(read_version(spark, root, 1)) == expected
    with pytest.raises(ContractError):
        write_version(start.withColumnRenamed("v", "w"), root)


def test_scratch_needs_a_shared_folder_beyond_one_process(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "/w"}.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")
    Context.master = "local[3]"
    assert scratch_dir(Session(), "x").startswith("/w/scratch/x-")
    with pytest.raises(ValueError, match="Not a scratch folder"):
        drop_scratch(spark, "/tmp/somewhere")


def test_overwrite_checks_root_paths(spark, tmp_path):
    inner = str(tmp_path / "t" / "inner")
    spark.range(3).write.parquet(inner)
    for target in (inner, str(tmp_path / "t"), f"{inner}/deeper"):
        with pytest.raises(ValueError, match="another path"):
            write_table(spark.read.parquet(inner), target, mode="overwrite")
    write_table(spark.read.parquet(inner), str(tmp_path / "t2"), mode="overwrite")
