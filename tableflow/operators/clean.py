"""Trimming, standardising and splitting tables by row rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import all_present, is_valid_price, named


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip spaces from both ends of every text column, in one projection."""
    return df.select(
        *(
            F.trim(named(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else named(f.name)
            for f in df.schema.fields
        )
    )


def standardize(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns by rule in one projection over the whole table.

    Every rule reads the input columns, also where another rule replaces one of them.
    """
    return df.withColumns(dict(rules))


def split_rows(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows). A null outcome of the rule is quarantined."""
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def split_prices(df: DataFrame, price: str = "close") -> tuple[DataFrame, DataFrame]:
    """Split on a valid price: not null, not NaN and above zero."""
    return split_rows(df, is_valid_price(price))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns`` (all columns by default). NaN is not null."""
    return df.filter(all_present(*(df.columns if columns is None else columns)))
