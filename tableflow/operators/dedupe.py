"""Keep the latest row per key, and whole-row distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.functions.columns import named
from tableflow.operators.clean import trim_strings
from tableflow.operators.contracts import require_groupable

_RANK = "__rank"


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order_by: str, tiebreak: Sequence[str]
) -> DataFrame:
    """One row per key: the one with the highest ``order_by``, then the highest tiebreak columns.

    A null order value loses against any other. Null keys form one group. The rank filter lets
    Spark keep one row per key and map task before the shuffle, so a key with very many versions
    does not load one task.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("keys is empty: name the columns that tell rows apart")
    latest_first = Window.partitionBy(*map(named, keys)).orderBy(
        *(named(c).desc_nulls_last() for c in [order_by, *tiebreak])
    )
    return (
        df.withColumn(_RANK, F.row_number().over(latest_first))
        .filter(F.col(_RANK) == 1)
        .drop(_RANK)
    )


def clean_distinct(df: DataFrame) -> DataFrame:
    """Trim all text columns, then drop rows that are equal in every column.

    The aggregation collapses copies within each map task before the shuffle.
    """
    return trim_strings(require_groupable(df)).dropDuplicates()
