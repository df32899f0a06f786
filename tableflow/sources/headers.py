"""Folders of CSV files whose headers differ, bound by name file by file."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.contracts import ContractError
from tableflow.operators.skew import fits_broadcast
from tableflow.sources.scratch import drop_scratch, written

#: More headers than this are taken for files without any. The parse has one expression for each.
MAX_HEADERS = 100


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank, its file, and whether it lies in the file's first block."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("first_block"),
    ).where(F.trim("line") != "")


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """The first line of each file as ``(file, header)``. A file without lines has none.

    This reads the text once, without parsing it; each map task keeps one line a file.
    """
    numbered = _lines(spark, path).where("first_block").withColumn("place", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("line", "place").alias("header"))


def _fields(header: str, declared: T.StructType, broken: str) -> T.StructType:
    """The fields of one header: declared ones by name, others as text, and the broken line behind them."""
    names = next(csv.reader([header]))
    known = {f.name: f for f in declared.fields}
    if twice := [n for n in known if names.count(n) > 1]:
        raise ContractError(f"A header names the columns {twice} more than once: {names}")
    fields = [known.get(n, T.StructField(f"__other{i}", T.StringType())) for i, n in enumerate(names)]
    return T.StructType([*fields, T.StructField(broken, T.StringType())])


def parse_by_header(
    spark: SparkSession, path: str, declared: T.StructType, broken: str, max_headers: int = MAX_HEADERS
) -> tuple[DataFrame, str]:
    """The declared columns and the broken line, or null, of every line; and a scratch folder to drop once that is stored.

    A column that a file's header lacks is null in its rows; one that no header has raises. Only distinct headers come to the driver,
    ``max_headers`` at most. Files are told their header by a join that is a broadcast where the list of files is small enough, and the
    text is read once more. A line equal to its file's header is a header too, so files that were put together keep their rows only.
    Fields with line breaks are not supported.
    """
    files, folder = written(file_headers(spark, path), "headers")
    try:
        found = [r["header"] for r in files.select("header").distinct().orderBy("header").limit(max_headers + 1).collect()]
        if len(found) > max_headers:
            raise ContractError(f"More than {max_headers} different headers; one is {found[0]!r}")
        schemas = [_fields(header, declared, broken) for header in found]
        _require_all(found, schemas, declared)
    except ContractError:
        drop_scratch(spark, folder)
        raise
    side = F.broadcast(files) if fits_broadcast(files) else files
    lines = _lines(spark, path).join(side, "file").where("line != header")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    parsed = lines.select(
        F.lit(None).alias("none"),
        *(
            F.when(F.col("header") == header, F.from_csv("line", _ddl(schema), options)).alias(f"p{i}")
            for i, (header, schema) in enumerate(zip(found, schemas, strict=True))
        ),
    )
    wanted = [*declared.fields, T.StructField(broken, T.StringType())]
    return parsed.select(*(_either(schemas, f.name, f.dataType) for f in wanted)), folder


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _either(schemas: Sequence[T.StructType], name: str, dtype: T.DataType) -> Column:
    """The column of whichever header a line has."""
    held = [F.col(f"p{i}").getField(name) for i, s in enumerate(schemas) if name in s.fieldNames()]
    return F.coalesce(*held, F.lit(None).cast(dtype)).alias(name)


def _require_all(found: Sequence[str], schemas: Sequence[T.StructType], declared: T.StructType) -> None:
    absent = [f.name for f in declared.fields if not any(f.name in s.fieldNames() for s in schemas)]
    if absent and found:
        raise ContractError(f"No header has the columns {absent}; one is {found[0]!r}")
