"""Tables stored in buckets of a key, so that work by that key needs no shuffle.

``latest_per_key`` and ``upsert`` over bucketed tables read each bucket in one task: rows of a key are together already, and two tables with
equal keys and numbers of buckets are joined bucket by bucket. The shuffle is paid once, at the write. A bucket is one task for every later job,
so this is for keys without hot values, like ids; choose the number so that a bucket fits a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tableflow.functions.columns import named
from tableflow.operators.contracts import require_columns
from tableflow.sources.readers import Schema, struct
from tableflow.sources.sinks import refuse_overwriting_input


def _checked(by: Sequence[str], buckets: int) -> list[str]:
    if not by:
        raise ValueError("At least one bucket column is required")
    if buckets < 1:
        raise ValueError("At least one bucket is required")
    return list(by)


def write_bucketed(
    df: DataFrame, name: str, path: str, by: Sequence[str], buckets: int, sort_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` to ``path`` as the table ``name`` of the session's catalog, and return it.

    One file for each bucket, sorted by ``by`` and ``sort_by``. The catalog tells readers about the buckets; a session that does not share it
    calls :func:`open_bucketed`. Files at ``path`` are replaced, unless ``df`` reads them, which raises.
    """
    keys = _checked(by, buckets)
    require_columns(df, [*keys, *sort_by])
    refuse_overwriting_input(df, path)
    (
        df.repartition(buckets, *map(named, keys))
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys, *sort_by)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def open_bucketed(
    spark: SparkSession, name: str, path: str, schema: Schema, by: Sequence[str], buckets: int, sort_by: Sequence[str] = ()
) -> DataFrame:
    """Register files that :func:`write_bucketed` left at ``path`` as the table ``name``, with the same keys and buckets."""
    keys, declared = _checked(by, buckets), struct(schema)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in declared.fields)
    listed = ", ".join(map(quoted, keys))
    order = ", ".join(map(quoted, [*keys, *sort_by]))
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
