"""The four jobs: read, check, transform, stamp, write.

``*_plan`` functions are the transformation alone; the jobs add reading and writing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from tableflow.functions.columns import ingest_stamp, parse_double, parse_timestamp
from tableflow.operators.clean import trim_strings
from tableflow.operators.contracts import require_columns, require_types
from tableflow.operators.dedupe import latest_per_key
from tableflow.operators.indicators import indicators
from tableflow.operators.segments import Split
from tableflow.sources.landing import Landed, land_text
from tableflow.sources.readers import TEXT_FORMATS, Schema, read_stream, read_table
from tableflow.sources.scratch import drop_scratch, written
from tableflow.sources.sinks import write_and_reconcile, write_table
from tableflow.streaming.append import DEFAULT_TRIGGER, run_bounded, run_to_end, start_append
from tableflow.streaming.project import project_ticks

# --- Fixed values: columns and defaults of the jobs -----------------------------------------
TICK_COLUMNS = ["symbol", "event_time", "close"]
CURATE_KEYS = ["id"]
CURATE_ORDER = "updated_at"
CURATE_REQUIRED = ["id", "updated_at"]
CURATE_TYPES = {"id": "string"}
BRONZE_PARTITION = "symbol"
# -------------------------------------------------------------------------------------------


def _tick_types() -> dict[str, Column]:
    return {"event_time": parse_timestamp("event_time"), "close": parse_double("close")}


def _raw(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: Schema | None,
    infer_schema: bool,
    fallback_path: str | None,
    quarantine_path: str | None,
) -> tuple[DataFrame, Landed | None]:
    """Text with a declared schema is landed; anything else is a table already."""
    if fmt in TEXT_FORMATS and schema is not None:
        landed = land_text(
            spark, path, fmt, schema, fallback_path=fallback_path, quarantine_path=quarantine_path
        )
        return landed.rows, landed
    table = read_table(spark, path, fmt, schema, infer_schema=infer_schema, fallback_path=fallback_path)
    return table, None


def _drop(landed: Landed | None) -> None:
    if landed is not None:
        landed.drop()


def market_plan(
    ticks: DataFrame,
    *,
    tiebreak: Sequence[str],
    split: Split | None = None,
    as_of: str | Column | None = None,
) -> DataFrame:
    """Indicator table of ticks: casts, indicators, ingest stamp."""
    require_columns(ticks, [*TICK_COLUMNS, *tiebreak])
    typed = ticks.withColumns(_tick_types())
    return indicators(typed, tiebreak=tiebreak, split=split).withColumns(ingest_stamp(as_of))


def market_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    *,
    tiebreak: Sequence[str],
    input_format: str = "csv",
    schema: Schema | None = None,
    infer_schema: bool = False,
    fallback_path: str | None = None,
    quarantine_path: str | None = None,
    output_format: str = "parquet",
    split: Split | None = None,
    as_of: str | Column | None = None,
) -> DataFrame:
    """Read ticks, compute indicators, overwrite the output table. Returns the output table.

    The raw rows are parsed and typed once, into a table below the shared folder that is dropped at the end.
    Broken lines of text go to ``quarantine_path``, or fail the job if there is none.
    """
    ticks, landed = _raw(
        spark, input_path, input_format, schema, infer_schema, fallback_path, quarantine_path
    )
    require_columns(ticks, [*TICK_COLUMNS, *tiebreak])
    typed, path = written(ticks.withColumns(_tick_types()), "ticks")
    _drop(landed)
    result = market_plan(typed, tiebreak=tiebreak, split=split, as_of=as_of)
    write_table(result, output_path, mode="overwrite", fmt=output_format)
    drop_scratch(spark, path)
    return spark.read.format(output_format).load(output_path)


def curate_plan(
    raw: DataFrame,
    *,
    keys: Sequence[str] = CURATE_KEYS,
    order_by: str = CURATE_ORDER,
    tiebreak: Sequence[str],
    required: Sequence[str] = CURATE_REQUIRED,
    types: Mapping[str, str] | None = None,
    as_of: str | Column | None = None,
) -> DataFrame:
    """Curated table: trim text, parse the order column, latest row per key, check, stamp.

    Dropping whole-row copies first would not change the outcome, since one row per key is left
    either way, so that shuffle is saved.
    """
    require_columns(raw, [*required, *keys, order_by, *tiebreak])
    typed = trim_strings(raw).withColumn(order_by, parse_timestamp(order_by))
    latest = latest_per_key(typed, keys, order_by, tiebreak)
    require_types(latest, CURATE_TYPES if types is None else types)
    return latest.withColumns(ingest_stamp(as_of))


def curate_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    *,
    tiebreak: Sequence[str],
    input_format: str = "json",
    schema: Schema | None = None,
    infer_schema: bool = False,
    keys: Sequence[str] = CURATE_KEYS,
    order_by: str = CURATE_ORDER,
    required: Sequence[str] = CURATE_REQUIRED,
    types: Mapping[str, str] | None = None,
    quarantine_path: str | None = None,
    output_format: str = "parquet",
    as_of: str | Column | None = None,
) -> DataFrame:
    """Read raw rows, curate them, overwrite the output table. Returns the output table.

    Broken lines of text go to ``quarantine_path``, or fail the job if there is none.
    """
    raw, landed = _raw(spark, input_path, input_format, schema, infer_schema, None, quarantine_path)
    result = curate_plan(
        raw,
        keys=keys,
        order_by=order_by,
        tiebreak=tiebreak,
        required=required,
        types=types,
        as_of=as_of,
    )
    write_table(result, output_path, mode="overwrite", fmt=output_format)
    _drop(landed)
    return spark.read.format(output_format).load(output_path)


def bronze_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    *,
    input_format: str = "csv",
    schema: Schema | None = None,
    infer_schema: bool = False,
    fallback_path: str | None = None,
    time: str = "event_time",
    partition_by: str = BRONZE_PARTITION,
    quarantine_path: str | None = None,
    as_of: str | Column | None = None,
) -> tuple[DataFrame, int]:
    """Read rows, stamp them, write Parquet by partition, and reconcile what was written.

    Returns (reconcile report, rows sent). The stamp and the parsed time are the only changes. Text is
    parsed once: the report reads the landed table. Broken lines go to ``quarantine_path``, or fail the
    job if there is none.
    """
    rows, _ = _raw(
        spark, input_path, input_format, schema, infer_schema, fallback_path, quarantine_path
    )
    require_columns(rows, [time, partition_by])
    stamped = rows.withColumns(ingest_stamp(as_of)).withColumn(time, parse_timestamp(time))
    return write_and_reconcile(stamped, output_path, partition_by)


def tick_stream_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    checkpoint: str,
    schema: Schema,
    *,
    run_seconds: float | None = 60,
    available_now: bool = False,
    trigger: str = DEFAULT_TRIGGER,
    max_files_per_trigger: int | None = None,
    time: str = "timestamp",
    value: str = "value",
    input_format: str = "parquet",
    output_format: str = "parquet",
) -> None:
    """Stream files into projected ticks and append them.

    By default the stream stops after ``run_seconds``, wherever it is. An ``available_now`` run is a
    backfill: it waits for the end, and raises if it has not come by ``run_seconds`` (None: no limit).
    """
    source = read_stream(
        spark, input_path, schema, input_format, max_files_per_trigger=max_files_per_trigger
    )
    query = start_append(
        project_ticks(source, time, value),
        output_path,
        checkpoint,
        trigger=trigger,
        available_now=available_now,
        fmt=output_format,
    )
    if available_now:
        run_to_end(query, run_seconds)
    elif run_seconds is None:
        query.stop()
        raise ValueError("A stream without an end needs run_seconds")
    else:
        run_bounded(query, run_seconds)
