"""Batch and streaming scans with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tableflow.operators.contracts import ContractError

TEXT_FORMATS = ("csv", "json")
COLUMNAR_FORMATS = ("parquet", "orc", "delta")

Schema = T.StructType | str


def struct(schema: Schema) -> T.StructType:
    """A declared schema as a type."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _names(schema: Schema) -> list[str]:
    return [f"`{name}`" for name in struct(schema).fieldNames()]


def csv_header(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> list[str]:
    """The column names of the first file."""
    return spark.read.options(**dict(options or {})).option("header", True).csv(path).columns


def bind_by_name(found: Sequence[str], schema: Schema) -> T.StructType:
    """The declared fields in the order of the columns found; columns not declared are text.

    Raises if a declared column is not there. Files with another header than the first fail at the read.
    """
    declared = {f.name: f for f in struct(schema).fields}
    if absent := [name for name in declared if name not in found]:
        raise ContractError(f"The files lack the columns {absent}; their header has {list(found)}")
    return T.StructType([declared.get(name, T.StructField(name, T.StringType())) for name in found])


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: Schema | None = None,
    *,
    infer_schema: bool = False,
    fallback_path: str | None = None,
    probe: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan ``path`` as csv (header row), json (one object per line), parquet, orc or delta.

    Columns of csv are bound by the names in the header, whatever their order, and a declared one that
    is absent raises. Lines that do not parse become nulls, as do absent fields of json:
    :func:`tableflow.sources.landing.land_text` tells both apart.

    Text needs a declared schema; ``infer_schema=True`` opts in to a second pass over the files
    that guesses one. An unknown format always raises. ``fallback_path`` is read only when
    ``path`` does not exist; no other failure is masked. ``probe`` reads one row at once, so that
    unreadable files fail here and not in a later job.
    """
    if fmt not in TEXT_FORMATS + COLUMNAR_FORMATS:
        raise ValueError(
            f"Unsupported format {fmt!r}, expected one of {TEXT_FORMATS + COLUMNAR_FORMATS}"
        )
    if fmt in TEXT_FORMATS and schema is None and not infer_schema:
        raise ValueError(f"Declare a schema for {fmt}, or pass infer_schema=True")

    def load(place: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**dict(options or {}))
        if fmt == "csv":
            reader = reader.option("header", True)
            if schema is None:
                return reader.option("inferSchema", True).load(place)
            found = csv_header(spark, place, options)
            in_file = bind_by_name(found, schema)
            return reader.option("enforceSchema", False).schema(in_file).load(place).select(*_names(schema))
        return (reader if schema is None else reader.schema(schema)).load(place)

    try:
        df = load(path)
    except AnalysisException as error:
        if fallback_path is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = load(fallback_path)
    if probe:
        df.limit(1).isEmpty()
    return df


def read_stream(
    spark: SparkSession,
    path: str,
    schema: Schema,
    fmt: str = "parquet",
    *,
    max_files_per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Stream the files that arrive in a directory. The schema is always declared.

    Columns of csv are bound by the names in the header of the first file, or in the declared order where there is no file yet; a
    declared one that is absent raises. A later file with another header fails the stream instead of being read by position.
    """
    if fmt not in (*TEXT_FORMATS, "parquet", "orc"):
        raise ValueError(f"Unsupported streaming format {fmt!r}")
    in_file = struct(schema)
    reader = spark.readStream.format(fmt).options(**dict(options or {}))
    if fmt == "csv":
        if found := _streamed_header(spark, path, options):
            in_file = bind_by_name(found, schema)
        reader = reader.option("header", True).option("enforceSchema", False)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.schema(in_file).load(path)
    return stream.select(*_names(schema)) if fmt == "csv" else stream


def _streamed_header(spark: SparkSession, path: str, options: Mapping[str, str] | None) -> list[str]:
    """The header of the files that are there; none for a folder without files."""
    try:
        return csv_header(spark, path, options)
    except AnalysisException as error:
        if error.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            return []
        raise
