"""Scratch folders that every executor can reach."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_OPEN: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)
_OWN = re.compile(r".+-[0-9a-f]{32}/*")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a session in one process uses its warehouse folder; any other
    session raises, because a folder of one machine would be lost with it.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"Set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (opened := _OPEN.get()) is not None:
        opened.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Everything that operators write to scratch folders inside the block is dropped at its end, also after an error.

    A result that still reads such folders must be stored or consumed inside the block. Scopes may be nested; an inner one drops its own. The
    block's value lists the folders so far.
    """
    opened: list[str] = []
    token = _OPEN.set(opened)
    try:
        yield opened
    finally:
        _OPEN.reset(token)
        drop_scratch(spark, *opened)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in a fresh scratch folder and read from there, and the folder."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders that :func:`scratch_dir` named, wherever they are."""
    for path in paths:
        if not _OWN.fullmatch(path):
            raise ValueError(f"Not a scratch folder: {path}")
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


class Scratch:
    """Tables written for the steps of one operator, dropped together once its result is stored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back, until :meth:`drop`."""
        table, path = written(df, name)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        drop_scratch(self.spark, *self.paths)
        self.paths.clear()
