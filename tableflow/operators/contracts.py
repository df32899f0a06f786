"""Data contracts: column and type checks on metadata, and row checks in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import zip_longest
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.columns import all_present, is_valid_price, named

REPORT_SCHEMA = "check string, column string, expected string, actual string, violations bigint"


class ContractError(ValueError):
    """A table does not meet its contract. The message lists every violation."""


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Listed columns the table lacks. Names are case-sensitive."""
    present = set(df.columns)
    return [c for c in columns if c not in present]


def has_columns(df: DataFrame, columns: Sequence[str]) -> bool:
    return not missing_columns(df, columns)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if absent := missing_columns(df, columns):
        raise ContractError(f"The table lacks {absent}; it has {df.columns}")
    return df


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Order, names, types, nullability and metadata must all be equal."""
    if df.schema != expected:
        differences = [
            {"position": i, "expected": w, "found": f}
            for i, (w, f) in enumerate(zip_longest(expected.fields, df.schema.fields))
            if w != f
        ]
        raise ContractError(f"Schema mismatch: {differences}")
    return df


class TypeLine(NamedTuple):
    """What a contract says of one column's type, and what the table has; None is no such column."""

    column: str
    expected: str
    actual: str | None
    ok: bool


def type_lines(df: DataFrame, types: Mapping[str, str], case_sensitive: bool = True) -> Iterator[TypeLine]:
    """One line for each column of the contract, in its order."""
    for column, expected in types.items():
        actual = df.schema[column].dataType.simpleString() if column in df.columns else None
        pair = (expected, actual or "")
        ok = pair[0] == pair[1] if case_sensitive else pair[0].lower() == pair[1].lower()
        yield TypeLine(column, expected, actual, ok)


def require_types(
    df: DataFrame, types: Mapping[str, str], case_sensitive: bool = True
) -> DataFrame:
    """Listed columns must have the given types; other columns are allowed."""
    wrong = [line for line in type_lines(df, types, case_sensitive) if not line.ok]
    if wrong:
        told = "; ".join(f"{x.column} is {x.actual or 'absent'} instead of {x.expected}" for x in wrong)
        raise ContractError(f"Types differ from the contract: {told}")
    return df


def require_appendable(df: DataFrame, existing: T.StructType) -> DataFrame:
    """Names and types must equal those of the table that ``df`` is appended to."""
    known = dict(zip(existing.fieldNames(), (f.dataType.simpleString() for f in existing), strict=True))
    unknown = [c for c in df.columns if c not in known]
    if unknown:
        raise ContractError(f"The stored table has no columns {unknown}")
    return require_types(df, known)


def _is_fractional(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def _nan_count(field: T.StructField) -> Column:
    if not _is_fractional(field):
        return F.lit(0).cast("bigint")
    return F.count_if(F.isnan(named(field.name)))


def null_nan_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls and NaNs per column as ``(column, rows, nulls, nans)``: one scan, one row."""
    names = list(df.columns if columns is None else columns)
    require_columns(df, names)
    fields = [df.schema[c] for c in names]
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        counts.append(F.count_if(named(field.name).isNull()).alias(f"nulls_{i}"))
        counts.append(_nan_count(field).alias(f"nans_{i}"))
    lines = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("column"),
                F.col("rows"),
                F.col(f"nulls_{i}").alias("nulls"),
                F.col(f"nans_{i}").alias("nans"),
            )
            for i, f in enumerate(fields)
        )
    )
    return df.agg(*counts).select(F.inline(lines))


def require_no_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Run the profile and raise if a listed column holds a NaN."""
    bad = [r["column"] for r in null_nan_profile(df, columns).collect() if r["nans"]]
    if bad:
        raise ContractError(f"Columns contain NaN: {bad}")
    return df


def quality_report(
    df: DataFrame,
    *,
    required: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
    prices: Sequence[str] = (),
    complete: Sequence[str] = (),
    case_sensitive: bool = True,
) -> DataFrame:
    """Contract and quality checks as ``(check, column, expected, actual, violations)``.

    ``required`` and ``types`` look at metadata. ``prices`` (valid price), ``complete`` (rows
    with a null in any listed column) and NaN counts of all fractional columns come from one
    scan of the data.
    """
    missing = set(missing_columns(df, required))

    lines: list[tuple[str, str, str, str | None, Column]] = []
    for c in required:
        found = "missing" if c in missing else "present"
        lines.append(("required", c, "present", found, F.lit(int(c in missing))))
    for line in type_lines(df, types or {}, case_sensitive):
        lines.append(("type", line.column, line.expected, line.actual, F.lit(int(not line.ok))))
    require_columns(df, [*prices, *complete])
    for c in prices:
        bad = F.count_if(~is_valid_price(c))
        lines.append(("valid_price", c, "> 0", None, bad))
    if complete:
        bad = F.count_if(~all_present(*complete))
        lines.append(("complete", ",".join(complete), "no nulls", None, bad))
    for field in filter(_is_fractional, df.schema.fields):
        lines.append(("nan", field.name, "no NaN", None, _nan_count(field)))
    if not lines:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)

    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(line[4].cast("bigint").alias(f"v{i}") for i, line in enumerate(lines)),
    )
    structs = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            F.lit(expected).alias("expected"),
            F.lit(found).cast("string").alias("actual"),
            F.col(f"v{i}").alias("violations"),
        )
        for i, (check, column, expected, found, _) in enumerate(lines)
    ]
    return counts.select(F.inline(F.array(*structs)))


def require_clean(report: DataFrame) -> None:
    """Raise with every violated line of a quality report. A report has a line per check."""
    bad = [r.asDict() for r in report.filter("violations > 0").collect()]
    if bad:
        raise ContractError(f"Quality checks failed: {bad}")


def require_groupable(df: DataFrame) -> DataFrame:
    """Rows with MAP columns cannot be compared, so they cannot be made distinct."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if maps:
        raise ContractError(f"MAP columns cannot be compared: {maps}")
    return df
