"""Frames of the last ``period`` rows for long periods, at a cost that grows with the logarithm of the period.

Spark's sliding frame adds up all its rows anew for each row. Here the frame of 8 rows is merged from 8 single rows, that of 64 from
eight frames of 8, and so on; each is the same column some rows earlier, which ``lag`` finds without a search. Any period is a sum of
such frames. All steps share one partitioning and order, so there is one shuffle and one sort however long the period is.

Frames are only ever merged, never subtracted from each other. So a NaN, an infinity or a very large value leaves no trace in
frames that do not hold it, and errors are those of pairwise sums. A frame with a null, or one that reaches back before the series, is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tableflow.functions.columns import named

#: Frames that make up one of the next size.
BASE = 8

#: Columns of one frame, and how many rows it covers.
Frame = tuple[list[Column], int]
#: The columns of several frames merged, later frames first, as (name, column) steps that may use the names of steps before.
Merge = Callable[[list[Frame], list[str]], list[dict[str, Column]]]


def add(frames: list[Frame], names: list[str]) -> list[dict[str, Column]]:
    """Sums of each column."""
    return [{n: reduce(Column.__add__, (columns[i] for columns, _ in frames)) for i, n in enumerate(names)}]


def merge_moments(frames: list[Frame], names: list[str]) -> list[dict[str, Column]]:
    """(mean, sum of squared distances from it) of all frames together."""
    mean, square = names
    total = sum(n for _, n in frames)
    squares = (s + (m - named(mean)) * (m - named(mean)) * n for (m, s), n in frames)
    return [
        {mean: reduce(Column.__add__, (m * (n / total) for (m, _), n in frames))},
        {square: reduce(Column.__add__, squares)},
    ]


def sliding(
    rows: DataFrame, window: WindowSpec, state: Sequence[str], periods: Sequence[int], merge: Merge
) -> tuple[DataFrame, dict[int, list[str]]]:
    """``rows`` with the merged ``state`` of the last rows for each of ``periods``, and the names of those columns.

    ``state`` names columns that hold the state of a frame of one row. ``window`` is ordered and has no frame. Columns of the steps between,
    whose names begin with ``__``, are still there: the caller selects what it needs, and Spark prunes the rest.
    """
    if not periods or min(periods) < 1:
        raise ValueError("Periods must be greater than zero")
    whole = list(state)
    found: dict[int, list[str] | None] = dict.fromkeys(periods)
    covered = dict.fromkeys(periods, 0)
    size, level = 1, 0
    while size <= max(periods):
        grows = size * BASE <= max(periods)
        digits = {p: (p // size) % BASE if grows else p // size for p in found}
        steps = {j * size for j in range(BASE)} if grows else set()
        steps |= {covered[p] + j * size for p, digit in digits.items() for j in range(digit)}
        lagged = {(s, c): f"__{level}_{s}_{i}" for s in sorted(steps - {0}) for i, c in enumerate(whole)}
        rows = rows.withColumns({name: F.lag(named(c), s).over(window) for (s, c), name in lagged.items()})

        def at(step: int) -> list[Column]:
            return [named(lagged.get((step, c), c)) for c in whole]  # noqa: B023

        merges: list[list[dict[str, Column]]] = []
        for p, digit in digits.items():
            if not digit:
                continue
            frames = [([named(c) for c in found[p]], covered[p])] if found[p] else []
            frames += [(at(covered[p] + j * size), size) for j in range(digit)]
            found[p] = [f"__{level}_of_{p}_{i}" for i in range(len(whole))]
            covered[p] += digit * size
            merges.append(merge(frames, found[p]))
        after: list[str] = []
        if grows:
            after = [f"__{level}_whole_{i}" for i in range(len(whole))]
            merges.append(merge([(at(j * size), size) for j in range(BASE)], after))
        for step in zip_longest(*merges, fillvalue={}):
            rows = rows.withColumns({n: c for columns in step for n, c in columns.items()})
        whole, size, level = after or whole, size * BASE, level + 1
    return rows, {p: list(columns or []) for p, columns in found.items()}
