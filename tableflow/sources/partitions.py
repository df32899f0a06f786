"""Upserts into a partitioned table that rewrite only the partitions they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import named
from tableflow.operators.contracts import require_appendable, require_columns
from tableflow.operators.skew import BROADCAST_VALUES
from tableflow.operators.upsert import Assignments, upsert
from tableflow.sources.readers import Schema, struct
from tableflow.sources.scratch import drop_scratch, written
from tableflow.sources.sinks import existing_partitioning, existing_schema


def _touched(stored: DataFrame, source: DataFrame, column: str) -> tuple[DataFrame, str | None]:
    """Rows of the partitions that the source names. A list of values prunes folders; a long one is joined instead."""
    values = source.select(named(column)).distinct()
    if values.count() > BROADCAST_VALUES:
        listed, path = written(values.toDF("__value"), "partitions")
        return stored.join(listed, named(column).eqNullSafe(F.col("__value")), "left_semi"), path
    found = [r[0] for r in values.collect()]
    wanted = named(column).isin([v for v in found if v is not None])
    return stored.where(wanted | named(column).isNull() if None in found else wanted), None


def upsert_partitions(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    *,
    schema: Schema,
    partition_by: str,
    on: Sequence[str],
    set: Assignments,
    insert: Assignments,
    **how: object,
) -> DataFrame:
    """Apply a batch upsert to the Parquet table at ``path``, partitioned by one column, and return the table.

    ``on`` must hold the partition column, so that a source row can only match rows of its own partition. Partitions that the source names are
    read, merged, and replaced as a whole once the merged files are complete; files of all others are neither read nor written. The partition
    column can't be assigned, and inserted rows take it from the source. ``schema`` declares the types, since partition values are texts in
    folder names. ``how`` is passed on to :func:`tableflow.upsert`. An empty source changes nothing.
    """
    declared = struct(schema)
    if partition_by not in on:
        raise ValueError(f"The keys must hold the partition column {partition_by!r}")
    if partition_by in set or insert.get(partition_by) != partition_by:
        raise ValueError(f"{partition_by!r} can't be assigned, and inserts must take it from the source")
    require_columns(source, [partition_by])
    if existing_schema(spark, path, "parquet") is None:
        raise ValueError(f"No table at {path}")
    found = existing_partitioning(spark, path, "parquet")
    if found not in (None, [partition_by]):
        raise ValueError(f"The table is partitioned by {found}, not by {[partition_by]}")
    stored = spark.read.schema(declared).parquet(path).select(*map(named, declared.fieldNames()))
    source, copy = written(source.withColumn(partition_by, named(partition_by).cast(declared[partition_by].dataType)), "changes")
    touched, listed = _touched(stored, source, partition_by)
    merged = upsert(touched, source, on=list(on), set=set, insert=insert, **how)
    require_appendable(merged.drop(partition_by), T.StructType([f for f in declared.fields if f.name != partition_by]))
    (
        merged.hint("rebalance", named(partition_by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .parquet(path)
    )
    drop_scratch(spark, copy, *([listed] if listed else []))
    return spark.read.schema(declared).parquet(path).select(*map(named, declared.fieldNames()))
