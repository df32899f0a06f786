"""CSV files with different headers in one folder."""

import pytest
from pyspark.sql import functions as F

from tableflow import ContractError, land_text
from tableflow.sources.headers import file_headers, parse_by_header
from tableflow.sources.readers import struct

SCHEMA = "id bigint, symbol string, close double"


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def landed(spark, path, **more):
    out = land_text(spark, path, "csv", SCHEMA, mixed_headers=True, **more)
    return out, sorted((tuple(r) for r in out.rows.collect()), key=repr)


def test_columns_are_bound_by_each_files_header(spark, tmp_path):
    path = folder(
        tmp_path,
        a="id,symbol,close\n1,BTC,2.5\n2,,\n",
        b='close,note,id,symbol\n\n3.5,"x, y",3,"E\\"TH"\n',
        c="symbol,id\nADA,4\n\"\",5\n",
        d="",
        e="id,symbol,close\n",
    )
    out, found = landed(spark, path)
    wanted = [(1, "BTC", 2.5), (2, None, None), (3, 'E"TH', 3.5), (4, "ADA", None), (5, None, None)]
    assert found == sorted(wanted, key=repr) and (out.n_lines, out.n_broken) == (5, 0)
    out.drop()


def test_broken_lines_of_every_header_go_to_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = folder(tmp_path / "in", a="id,symbol,close\n1,BTC\nx,ETH,1\n2,ETH,1\n", b="symbol,id\nADA,3,9\nADA,4\n")
    out, found = landed(spark, path, quarantine_path=str(tmp_path / "broken"))
    assert found == [(2, "ETH", 1.0), (4, "ADA", None)]
    assert sorted(r["line"] for r in out.broken.collect()) == ["1,BTC", "ADA,3,9", "x,ETH,1"]
    with pytest.raises(ContractError, match="3 of 5 lines"):
        landed(spark, path)


def test_headers_inside_a_file_are_no_rows(spark, tmp_path):
    _, found = landed(spark, folder(tmp_path, a="id,symbol,close\n1,A,1\nid,symbol,close\n2,B,2\n"))
    assert found == [(1, "A", 1.0), (2, "B", 2.0)]


def test_column_that_no_header_has(spark, tmp_path):
    with pytest.raises(ContractError, match=r"No header has the columns \['close'\]"):
        landed(spark, folder(tmp_path, a="id,symbol\n1,A\n", b="symbol,id\nA,1\n"))


def test_column_named_twice(spark, tmp_path):
    with pytest.raises(ContractError, match="more than once"):
        landed(spark, folder(tmp_path, a="id,symbol,close,id\n1,A,1,2\n"))


def test_too_many_headers(spark, tmp_path):
    path = folder(tmp_path, **{f"f{i}": f"id,symbol,close,x{i}\n{i},A,1,\n" for i in range(5)})
    with pytest.raises(ContractError, match="More than 4 different headers"):
        parse_by_header(spark, path, struct(SCHEMA), "broken", max_headers=4)
    assert parse_by_header(spark, path, struct(SCHEMA), "broken", max_headers=5)[0].count() == 5


def test_files_cut_into_many_tasks(spark, tmp_path):
    text = "".join(f"{i},{'s' * (i % 50)},{i / 2}\n" for i in range(20_000))
    other = "".join(f"{i / 2},{i}\n" for i in range(20_000, 30_000))
    path = folder(tmp_path, a="id,symbol,close\n" + text, b="close,id\n" + other)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert {r["header"] for r in file_headers(spark, path).collect()} == {"id,symbol,close", "close,id"}
        out = land_text(spark, path, "csv", SCHEMA, mixed_headers=True)
        sums = out.rows.agg(F.count("*"), F.sum("id"), F.sum("close"), F.count("symbol")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    total = sum(range(30_000))
    assert tuple(sums) == (30_000, total, total / 2, 20_000 - 400)


def test_folder_of_empty_files(spark, tmp_path):
    out, found = landed(spark, folder(tmp_path, a="", b="\n\n"))
    assert found == [] and out.n_lines == 0
