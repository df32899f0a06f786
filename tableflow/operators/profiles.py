"""Profiles of columns that merge: exact counts, extremes, and sketches of distinct values and of quantiles.

A state is one row per column, and per partition where partition columns are named. Stored beside a table, the states of changed
partitions are made anew and the others stay; a profile of the whole table is merged from them without a row being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import named
from tableflow.operators.contracts import ContractError, require_columns

#: Shares at which two profiles' quantiles are compared: the distance of their distributions comes out in hundredths.
GRID = [i / 100 for i in range(101)]
NUMBERS = (T.NumericType,)

_COUNTS = ("rows", "nulls", "nans")
_STATE = ("column", "type", *_COUNTS, "low", "high", "distinct_sketch", "value_sketch")


def _line(field: T.StructField, i: int) -> tuple[list[Column], Column]:
    """The aggregates of one column, and the state's row made of them."""
    value = named(field.name)
    is_number = isinstance(field.dataType, NUMBERS)
    double = value.cast("double") if is_number else F.lit(None).cast("double")
    finite = F.when(~F.isnan(double), double)
    text = F.to_json(F.struct(value)) if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")
    parts = {
        "nulls": F.count_if(value.isNull()),
        "nans": F.count_if(F.coalesce(F.isnan(double), F.lit(False))),
        "low": F.min(finite),
        "high": F.max(finite),
        "distinct_sketch": F.hll_sketch_agg(F.when(value.isNotNull(), text)),
        "value_sketch": F.kll_sketch_agg_double(finite) if is_number else F.max(F.lit(None).cast("binary")),
    }
    row = F.struct(
        F.lit(field.name).alias("column"),
        F.lit(field.dataType.simpleString()).alias("type"),
        F.col("__rows").alias("rows"),
        *(F.col(f"__{name}_{i}").alias(name) for name in parts),
    )
    return [part.alias(f"__{name}_{i}") for name, part in parts.items()], row


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, type, rows, nulls, nans, low, high, distinct_sketch, value_sketch)``, one scan.

    Without ``by`` an empty table gives its columns with counts of 0. ``low``, ``high`` and the sketch of values hold numbers without
    NaN, as doubles; other types have nulls there. Distinct values are told apart by their text, NaN being one, null none. Everything is combined
    in the map tasks: a task passes on a row per partition value, some kilobytes a column, however many rows it read.
    """
    names = [c for c in df.columns if c not in by] if columns is None else list(columns)
    require_columns(df, [*names, *by])
    if clash := [c for c in by if c in _STATE]:
        raise ContractError(f"Partition columns named like columns of a state: {clash}")
    if not names:
        raise ContractError("There is no column to profile")
    lines = [_line(df.schema[c], i) for i, c in enumerate(names)]
    counts = [F.count(F.lit(1)).alias("__rows"), *(a for made, _ in lines for a in made)]
    grouped = df.groupBy(*map(named, by)).agg(*counts)
    return grouped.select(*map(named, by), F.inline(F.array(*(row for _, row in lines))))


def merge_profiles(states: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """States of parts that have no row in common as the states of the whole, or of each value of ``by``.

    A column whose type differs between parts keeps one row per type.
    """
    require_columns(states, [*_STATE, *by])
    return states.groupBy(*map(named, by), "column", "type").agg(
        *(F.sum(c).alias(c) for c in _COUNTS),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.count("value_sketch") > 0, F.kll_merge_agg_double("value_sketch")).alias("value_sketch"),
    )


def _quantiles(shares: Sequence[float]) -> Column:
    """The values at the shares, or null where there is no number."""
    held = F.kll_sketch_get_n_double("value_sketch") > 0
    return F.when(held, F.kll_sketch_get_quantile_double("value_sketch", F.array(*map(F.lit, shares))))


def read_profile(states: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """States with estimates in place of sketches: ``distinct``, within some 2 percent, and the ``quantiles`` at ``shares``, within some 2 hundredths."""
    kept = [c for c in states.columns if c not in ("distinct_sketch", "value_sketch")]
    return states.select(
        *map(named, kept),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct"),
        _quantiles(shares).alias("quantiles"),
    )


def profile_drift(
    before: DataFrame,
    after: DataFrame,
    *,
    null_change: float = 0.01,
    distinct_change: float = 0.5,
    rank_change: float = 0.1,
) -> DataFrame:
    """How columns changed between two merged states: one row per column and type, with ``reasons`` and ``drifted``.

    Reasons, in this order: ``added`` or ``removed`` (also for a changed type; nothing else is compared then), ``nulls`` or ``nans`` where their
    share of rows moved by more than ``null_change``, ``distinct`` where the estimated number of values per row moved by more than that share of the larger
    one, and ``values`` where the distributions are more than ``rank_change`` apart: the largest difference of the shares of values up to any
    point of either side's grid. A side without rows or numbers is not compared in what it lacks.
    """
    sides = []
    for states, side in ((before, "before"), (after, "after")):
        need = states.groupBy("column", "type").agg(F.count("*").alias("n"))
        once = F.when(F.col("n") > 1, F.raise_error(F.lit("Merge the states first: a column has several"))).otherwise(F.lit(True))
        unique = need.where(once.cast("boolean")).drop("n")
        line = read_profile(states.select(*_STATE), GRID).join(unique, ["column", "type"])
        sides.append(line.select("column", "type", F.struct("*").alias(side)))
    both = sides[0].join(sides[1], ["column", "type"], "full")

    def share(side: str, part: str) -> Column:
        return F.try_divide(F.col(f"{side}.{part}").cast("double"), F.col(f"{side}.rows"))

    def up_to(side: str, x: Column) -> Column:
        return F.size(F.filter(F.col(f"{side}.quantiles"), lambda q: q <= x)) / len(GRID)

    grids = F.concat(F.col("before.quantiles"), F.col("after.quantiles"))
    distance = F.array_max(F.transform(grids, lambda x: F.abs(up_to("before", x) - up_to("after", x))))
    shares = [(f"{part}_{side}", share(side, part)) for part in ("nulls", "nans", "distinct") for side in ("before", "after")]
    compared = both.select(
        "column",
        "type",
        F.col("before").isNull().alias("__new"),
        F.col("after").isNull().alias("__old"),
        *(value.alias(name) for name, value in shares),
        distance.alias("rank_distance"),
    )

    def moved(part: str) -> Column:
        return F.abs(F.col(f"{part}_after") - F.col(f"{part}_before"))

    larger = F.greatest("distinct_before", "distinct_after")
    rules = [
        ("added", F.col("__new")),
        ("removed", F.col("__old")),
        ("nulls", moved("nulls") > null_change),
        ("nans", moved("nans") > null_change),
        ("distinct", moved("distinct") > distinct_change * larger),
        ("values", F.col("rank_distance") > rank_change),
    ]
    reasons = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    return compared.withColumn("reasons", reasons).withColumn("drifted", F.size("reasons") > 0).drop("__new", "__old")
