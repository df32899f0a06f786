"""Streaming upsert: each micro-batch adds its newest rows, and readers take the newest row per key.

Layout below ``root``: ``batch=<id>`` holds the newest row per key of a micro-batch, and ``base=<id>``
all that the batches up to ``id`` amount to, written by :func:`compact`. What a batch writes depends on
the batch alone, not on the table. A replayed batch overwrites its own folder; one that is already
part of a base is not read. The result does not depend on how rows are dealt to micro-batches.

Rows with a null in a key match nothing and are all kept, as in a batch upsert.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tableflow.functions.columns import named
from tableflow.operators.dedupe import latest_per_key
from tableflow.sources.versions import committed, drop_versions

_BATCH = "batch"
_BASE = "base"
_FROM = "__from"


def _newest(rows: DataFrame, keys: Sequence[str], order_by: str, tiebreak: Sequence[str]) -> DataFrame:
    """The newest row of each key, and every row without a key."""
    keyless = reduce(Column.__or__, (named(k).isNull() for k in keys))
    keyed = latest_per_key(rows.filter(~keyless), keys, order_by, tiebreak)
    return keyed.unionByName(rows.filter(keyless))


def _stored(spark: SparkSession, root: str, schema: T.StructType, before: int | None) -> DataFrame:
    """Rows of the last base and of the batches after it, with the batch they come from."""
    bases = [n for n in committed(spark, root, _BASE) if before is None or n < before]
    start = bases[-1] if bases else None
    batches = [
        n
        for n in committed(spark, root, _BATCH)
        if (start is None or n > start) and (before is None or n < before)
    ]
    parts = [spark.createDataFrame([], schema).withColumn(_FROM, F.lit(-1).cast("bigint"))]
    if start is not None:
        base = spark.read.schema(schema).parquet(f"{root}/{_BASE}={start}")
        parts.append(base.withColumn(_FROM, F.lit(start).cast("bigint")))
    if batches:
        with_batch = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])
        reader = spark.read.schema(with_batch).option("basePath", root)
        found = reader.parquet(*[f"{root}/{_BATCH}={n}" for n in batches])
        parts.append(found.withColumnRenamed(_BATCH, _FROM))
    return reduce(DataFrame.unionByName, parts)


def current_table(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    *,
    keys: Sequence[str],
    order_by: str,
    tiebreak: Sequence[str],
    before: int | None = None,
) -> DataFrame:
    """The table after the last complete batch, or after the last one ``before`` a batch.

    Of equally new rows the one of the later batch is taken.
    """
    rows = _stored(spark, root, schema, before)
    return _newest(rows, keys, order_by, [*tiebreak, _FROM]).drop(_FROM)


def upsert_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    *,
    keys: Sequence[str],
    order_by: str,
    tiebreak: Sequence[str],
) -> None:
    """Write the newest rows of a micro-batch as batch ``batch_id``."""
    _newest(batch, keys, order_by, tiebreak).write.mode("overwrite").parquet(
        f"{root}/{_BATCH}={int(batch_id)}"
    )


def compact(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    *,
    keys: Sequence[str],
    order_by: str,
    tiebreak: Sequence[str],
) -> None:
    """Fold all complete batches into a new base and drop what it replaces.

    A job of its own, to be run as often as the batches since the last base get too many. Readers that
    have planned a read of the files it drops must read again.
    """
    batches, bases = committed(spark, root, _BATCH), committed(spark, root, _BASE)
    new = [n for n in batches if not bases or n > bases[-1]]
    if new:
        table = current_table(
            spark, root, schema, keys=keys, order_by=order_by, tiebreak=tiebreak, before=new[-1] + 1
        )
        table.write.mode("overwrite").parquet(f"{root}/{_BASE}={new[-1]}")
        drop_versions(spark, root, bases, _BASE)
    drop_versions(spark, root, batches, _BATCH)


def start_upsert(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    *,
    keys: Sequence[str],
    order_by: str,
    tiebreak: Sequence[str],
    trigger: str | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch of a stream. Without ``trigger``, work off what is there."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, root, keys=keys, order_by=order_by, tiebreak=tiebreak)

    when = {"availableNow": True} if trigger is None else {"processingTime": trigger}
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**when)
        .start()
    )
