"""Raw text, parsed once into a typed table, with broken lines set apart.

Jobs that need their input more than once, or have to know what is really in the files, land it
first: one pass over the text writes a Parquet table below the shared folder and counts, on the way,
lines, broken lines, and for json how many lines hold each declared field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import named
from tableflow.operators.contracts import ContractError
from tableflow.sources.headers import parse_by_header
from tableflow.sources.readers import TEXT_FORMATS, Schema, bind_by_name, csv_header, struct
from tableflow.sources.scratch import drop_scratch, scratch_dir

BROKEN = "__broken"
QUARANTINE_SCHEMA = "line string"


@dataclass(frozen=True)
class Landed:
    """Typed rows, the lines that did not parse, their numbers, and the folder that holds both."""

    rows: DataFrame
    broken: DataFrame
    n_lines: int
    n_broken: int
    path: str

    def drop(self) -> None:
        """Delete the landed table. Its DataFrames cannot be read any more."""
        drop_scratch(self.rows.sparkSession, self.path)


def land_text(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: Schema,
    *,
    fallback_path: str | None = None,
    quarantine_path: str | None = None,
    mixed_headers: bool = False,
) -> Landed:
    """Parse csv with a header row, or json lines, into the declared columns.

    A declared column that the header lacks, or a field that no line of json holds, raises. Broken lines
    are those with too few or too many fields, a value that does not fit its type, or no json object. They are
    appended to the table at ``quarantine_path``; without one, a broken line raises with their number.
    ``fallback_path`` is read only where ``path`` does not exist. ``mixed_headers`` allows csv files with different headers, see
    :func:`tableflow.sources.headers.parse_by_header`; fields that a file lacks are null in its rows. Fields of json may always differ.
    """
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"Only {TEXT_FORMATS} are landed, not {fmt!r}")
    declared = struct(schema)
    try:
        parsed, present, used = _parsed(spark, path, fmt, declared, mixed_headers)
    except AnalysisException as error:
        if fallback_path is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        parsed, present, used = _parsed(spark, fallback_path, fmt, declared, mixed_headers)

    seen = Observation()
    counts = [F.count(F.lit(1)).alias("lines"), F.count(BROKEN).alias("broken")]
    counts += [F.count_if(held).alias(f"held{i}") for i, held in enumerate(present)]
    folder = scratch_dir(spark, "landed")
    kept = [named(f.name) for f in declared.fields]
    parsed.observe(seen, *counts).select(*kept, BROKEN).write.parquet(folder)
    found = seen.get
    drop_scratch(spark, *used)
    n_lines, n_broken = int(found["lines"]), int(found["broken"])
    absent = [f.name for i, f in enumerate(declared.fields[: len(present)]) if not found[f"held{i}"]]
    stored = spark.read.schema(T.StructType([*declared.fields, T.StructField(BROKEN, T.StringType())])).parquet(folder)
    if absent and n_lines > n_broken:
        drop_scratch(spark, folder)
        raise ContractError(f"No line holds the fields {absent}")
    broken = stored.filter(named(BROKEN).isNotNull()).select(named(BROKEN).alias("line"))
    if n_broken and quarantine_path is None:
        example = broken.first()["line"]
        drop_scratch(spark, folder)
        raise ContractError(f"{n_broken} of {n_lines} lines do not parse, one is {example!r}; name a quarantine path")
    if n_broken:
        broken.write.mode("append").parquet(quarantine_path)
    rows = stored.filter(named(BROKEN).isNull()).select(*kept)
    return Landed(rows, broken, n_lines, n_broken, folder)


def _parsed(
    spark: SparkSession, path: str, fmt: str, declared: T.StructType, mixed_headers: bool
) -> tuple[DataFrame, list[Column], list[str]]:
    """The rows with the broken line, or null, beside them; for json whether a line holds a field; and scratch folders that are read."""
    broken = T.StructField(BROKEN, T.StringType())
    if fmt == "csv" and mixed_headers:
        parsed, folder = parse_by_header(spark, path, declared, BROKEN)
        return parsed, [], [folder]
    if fmt == "csv":
        in_file = bind_by_name(csv_header(spark, path), declared)
        reader = spark.read.option("header", True).option("enforceSchema", False)
        reader = reader.option("columnNameOfCorruptRecord", BROKEN).schema(T.StructType([*in_file.fields, broken]))
        return reader.csv(path), [], []
    lines = spark.read.text(path).filter(F.trim("value") != "")
    wanted = T.StructType([*(T.StructField(f.name, f.dataType) for f in declared.fields), broken])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    keys = F.json_object_keys("value")
    both = lines.select(F.from_json("value", wanted, options).alias("r"), F.col("value"), keys.alias("keys"))
    present = [F.array_contains("__keys", f.name) for f in declared.fields]
    no_object = F.col("keys").isNull()
    whole = F.when(no_object, F.col("value")).otherwise(F.col("r").getField(BROKEN))
    fields = [F.col("r").getField(f.name).alias(f.name) for f in declared.fields]
    return both.select(*fields, whole.alias(BROKEN), F.col("keys").alias("__keys")), present, []
