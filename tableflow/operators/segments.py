"""Trailing windows over series of any length.

A Spark window partition is processed by one task. With ``partitionBy(symbol)`` a symbol that
holds a third of all rows is one task with a third of all rows. The operators here need only a
fixed number of earlier rows (13 for a 14-row mean), so a long series can be cut into segments
that run in parallel, provided that each segment first sees the last rows before it.

How it works:

1. A count per key over a sample finds the long series. If there is none, the plain window is
   used. All other series always use it.
2. Rows of long series are numbered, dealt by Spark's range partitioner in the order (key, time, tiebreak,
   number), and written once. A partition holds about ``rows_per_segment`` neighbouring rows and is a
   segment of each series that has rows in it. The number tells rows apart that nothing else does,
   so a single instant with very many rows is split as well.
3. A table with one row per series and segment tells which segments follow within ``history`` rows. The last
   ``history`` rows of each segment are copied to those and dropped again after the window ran.

There is no bound on the number of long series or of segments: lists of both are tables. Rows of
long series are shuffled twice and written once, those of other series are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tableflow.functions.columns import named
from tableflow.sources.scratch import written

SEGMENT = "__segment"
HISTORY = "__history"
_RANK = "__rank"
_ROW = "__row"
_KEY = "__key"
_ROWS = "__rows"
_BETWEEN = "__between"
_PLACE = "__place"

#: Sampled rows that stand for a series of ``rows_per_segment`` rows.
_SAMPLED_ROWS = 200

#: The list of long series is broadcast while it is this short.
_BROADCAST_SERIES = 10_000


@dataclass(frozen=True)
class Split:
    """How finely long series are cut: one with more rows than ``rows_per_segment`` is long, and its
    segments have about that many."""

    rows_per_segment: int = 1_000_000

    def __post_init__(self) -> None:
        if self.rows_per_segment <= 0:
            raise ValueError("rows_per_segment must be greater than zero")


def series_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of one series in ascending order, nulls first."""
    return Window.partitionBy(*map(named, keys)).orderBy(
        *(named(c).asc_nulls_first() for c in order)
    )


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    history: int,
    inputs: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    split: Split | None = None,
) -> DataFrame:
    """Run ``compute(df, window)`` so that a long series is spread over many tasks.

    ``compute`` adds columns from window functions that look back at most ``history`` rows and
    never forward, over the columns ``inputs``. ``order`` should decide every pair of rows of a
    series. ``df`` is read more than once when there are long series, so pass a table rather than
    a costly derivation.
    """
    split = split or Split()
    found = long_series(df, keys, split)
    if found is None:
        return compute(df, series_window(keys, order))

    listed, long_rows = found
    by_key = df.withColumn(_KEY, _key(keys))
    short = by_key.join(listed, _KEY, "left_anti").drop(_KEY)
    segmented = _cut(by_key.join(listed, _KEY, "left_semi").drop(_KEY), keys, order, split, long_rows)
    # Positions within a tie are as good as any, but every reading must see the same.
    total = [*order, _ROW]
    rows = segmented.withColumn(HISTORY, F.lit(False))
    earlier = history_rows(segmented, keys, total, history, inputs)
    both = rows.unionByName(earlier, allowMissingColumns=True)
    result = compute(both, series_window([*keys, SEGMENT], total))
    result = result.filter(~named(HISTORY)).drop(SEGMENT, HISTORY, _ROW)
    return compute(short, series_window(keys, order)).unionByName(result)


def _key(keys: Sequence[str]) -> Column:
    """The key as one value that equals itself also where it holds nulls."""
    return F.struct(*(named(k).alias(f"k{i}") for i, k in enumerate(keys)))


def long_series(df: DataFrame, keys: Sequence[str], split: Split) -> tuple[DataFrame, int] | None:
    """The keys of long series, as a stored table, and about how many rows they have; None: no key.

    A sample is enough, and keeps the number of shuffled keys small where there are very many
    series: a series of ``rows_per_segment`` rows has about ``_SAMPLED_ROWS`` rows in it.
    """
    fraction = min(1.0, _SAMPLED_ROWS / split.rows_per_segment)
    rows, enough = df.select(_key(keys).alias(_KEY)), split.rows_per_segment
    if fraction < 1:
        # Half the expected number, so that a long series is hardly ever missed.
        rows, enough = rows.sample(fraction, seed=5), _SAMPLED_ROWS / 2
    counted = rows.groupBy(_KEY).agg(F.count(F.lit(1)).alias(_ROWS)).filter(named(_ROWS) > enough)
    if counted.isEmpty():  # mostly so; otherwise the sample is taken once more
        return None
    stored, _ = written(counted, "long_series")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(_ROWS).alias("rows")).first()
    listed = stored.select(_KEY)
    return F.broadcast(listed) if size["n"] <= _BROADCAST_SERIES else listed, int(size["rows"] / fraction)


def _cut(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], split: Split, long_rows: int
) -> DataFrame:
    """The rows in a written table, with the number of their segment and one of their own."""
    segments = max(2, -(-long_rows // split.rows_per_segment))
    numbered = rows.withColumn(_ROW, F.monotonically_increasing_id())
    by = [named(c).asc_nulls_first() for c in dict.fromkeys([*keys, *order, _ROW])]
    ranged = numbered.repartitionByRange(segments, *by).withColumn(SEGMENT, F.spark_partition_id())
    return written(ranged, "segments")[0]


def history_rows(
    segmented: DataFrame, keys: Sequence[str], order: Sequence[str], history: int, inputs: Sequence[str]
) -> DataFrame:
    """Copies of the last rows before each segment of a long series, labelled with that segment.

    Only the columns that decide later rows are copied.
    """
    needed = _needed(keys, order, inputs)
    latest_first = Window.partitionBy(*map(named, keys), named(SEGMENT)).orderBy(
        *(named(c).desc_nulls_last() for c in order)
    )
    tails = (
        segmented.select(*map(named, [*needed, SEGMENT]))
        .withColumn(_RANK, F.row_number().over(latest_first))
        .filter(named(_RANK) <= history)
    )
    pairs = _followers(segmented, keys, history)
    copied = tails.withColumn(_KEY, _key(keys)).join(pairs, [_KEY, SEGMENT])
    return (
        copied.filter(named(_RANK) + named(_BETWEEN) <= history)
        .withColumn(SEGMENT, named("__target"))
        .select(*map(named, [*needed, SEGMENT]))
        .withColumn(HISTORY, F.lit(True))
    )


def _followers(segmented: DataFrame, keys: Sequence[str], history: int) -> DataFrame:
    """(key, segment, later segment, rows between) for later segments that start within ``history`` rows.

    Mostly a segment and the next one. Each further step asks only where the segments in between are
    shorter than ``history``, so there are as many steps as short segments in a row.
    """
    sizes, _ = written(
        segmented.groupBy(_key(keys).alias(_KEY), SEGMENT)
        .agg(F.count(F.lit(1)).alias(_ROWS))
        .withColumn(_PLACE, F.row_number().over(Window.partitionBy(_KEY).orderBy(SEGMENT))),
        "sizes",
    )
    following = sizes.select(
        _KEY, (named(_PLACE) - 1).alias("__before"), named(SEGMENT).alias("__target"), named(_ROWS).alias("__size")
    )
    open_pairs = sizes.select(_KEY, SEGMENT, named(_PLACE).alias("__before"), F.lit(0).cast("bigint").alias(_BETWEEN))
    steps = []
    while True:
        step, _ = written(
            open_pairs.filter(named(_BETWEEN) < history).join(following, [_KEY, "__before"]), "followers"
        )
        if steps and step.isEmpty():
            break
        steps.append(step.select(_KEY, SEGMENT, "__target", _BETWEEN))
        open_pairs = step.select(
            _KEY, SEGMENT, (named("__before") + 1).alias("__before"), (named(_BETWEEN) + named("__size")).alias(_BETWEEN)
        )
    pairs = steps[0]
    for step in steps[1:]:
        pairs = pairs.unionByName(step)
    return pairs


def _needed(*names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(n for group in names for n in group))


def last_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], history: int, inputs: Sequence[str]
) -> DataFrame:
    """The last ``history`` rows of each series, with the columns that decide later rows.

    The rank is limited in the map tasks, so a task that reads many rows of a series passes on
    ``history`` of them.
    """
    latest_first = Window.partitionBy(*map(named, keys)).orderBy(
        *(named(c).desc_nulls_last() for c in order)
    )
    return (
        df.select(*map(named, _needed(keys, order, inputs)))
        .withColumn(_RANK, F.row_number().over(latest_first))
        .filter(named(_RANK) <= history)
        .drop(_RANK)
    )


def since(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Column,
    history: int,
    inputs: Sequence[str],
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Rows from ``start`` on, plus the last ``history`` rows of each series before it.

    The earlier rows have nulls outside keys, order and ``inputs``. They are those of ``earlier``, a table that
    :func:`last_rows` gave, or are found by reading the needed columns of all rows before ``start``.
    The caller filters on ``start`` again afterwards.
    """
    time = named(order[0])
    if earlier is None:
        before = last_rows(df.filter(time.isNull() | (time < start)), keys, order, history, inputs)
    else:
        before = earlier.select(*map(named, _needed(keys, order, inputs)))
        before = before.filter(time.isNull() | (time < start))
    return df.filter(time >= start).unionByName(before, allowMissingColumns=True)
