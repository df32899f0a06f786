"""Tables kept as whole versions in numbered folders, for changes that must not be seen half done.

A version is one folder, ``<root>/<name>=<number>``, written by one Spark job. It counts once the job has
left its success marker. A path that is being read is never overwritten. Listing costs one entry for
each version that has not been dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableflow.operators.contracts import require_appendable
from tableflow.operators.upsert import Assignments, upsert

VERSION = "version"


def committed(spark: SparkSession, root: str, name: str = VERSION) -> list[int]:
    """Numbers of the complete versions below ``root``, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def drop_versions(spark: SparkSession, root: str, numbers: list[int], name: str = VERSION) -> None:
    """Delete versions that no reader needs any more."""
    for number in numbers:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}={number}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_version(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write ``df`` as the next version, drop all but the last ``keep``, and return its number.

    Columns and types must be those of the version before. ``df`` may read that version.
    """
    spark = df.sparkSession
    before = committed(spark, root)
    if before:
        require_appendable(df, read_version(spark, root).schema)
    number = before[-1] + 1 if before else 0
    df.write.mode("overwrite").parquet(f"{root}/{VERSION}={number}")
    drop_versions(spark, root, [*before, number][: -max(keep, 1)])
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest complete version, or a given one."""
    numbers = committed(spark, root)
    wanted = numbers[-1] if number is None and numbers else number
    if wanted not in numbers:
        raise ValueError(f"No complete version {'' if number is None else number} below {root}")
    return spark.read.parquet(f"{root}/{VERSION}={wanted}")


def upsert_table(
    root: str,
    source: DataFrame,
    *,
    on: list[str],
    set: Assignments,
    insert: Assignments,
    keep: int = 2,
    **how,
) -> DataFrame:
    """Apply a batch upsert to the stored table below ``root`` and return the new version.

    ``how`` is passed on to :func:`tableflow.upsert`. A first call needs a version to start from, see
    :func:`write_version`. Readers of the version before are not disturbed.
    """
    spark = source.sparkSession
    changed = upsert(read_version(spark, root), source, on=on, set=set, insert=insert, **how)
    return read_version(spark, root, write_version(changed, root, keep))
