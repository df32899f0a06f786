"""Upsert: update matched rows of a target, insert unmatched rows of a source, keep the rest.

Update and insert values are Columns over the aliases ``target`` and ``source``, for example
``{"value": F.col("source.value")}``; a text stands for ``source.<text>``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.functions.columns import named
from tableflow.operators.contracts import require_columns
from tableflow.operators.ranges import RangeSplit, range_pairs
from tableflow.operators.skew import (
    BROADCAST_BYTES,
    HotKeys,
    fits_broadcast,
    hot_values,
    only_hot,
    without_hot,
)
from tableflow.sources.scratch import written

Assignments = Mapping[str, "str | Column"]

_ID = "__id"
_ROW = "__row"
_COUNT = "__count"
_NUMBER = "__number"


def _side(side: str, column: str) -> Column:
    return F.col(side + ".`" + column.replace("`", "``") + "`")


def _assignments(values: Assignments, target: DataFrame, what: str) -> dict[str, Column]:
    if not values:
        raise ValueError(f"{what} must not be empty")
    require_columns(target, list(values))
    return {k: _side("source", v) if isinstance(v, str) else v for k, v in values.items()}


def copy_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Assignments that take each column from the source column of the same name."""
    return {c: _side("source", c) for c in columns}


def newest_wins(columns: Sequence[str], order: Sequence[str]) -> dict[str, Column]:
    """Assignments that take the source's columns unless the target row is newer.

    ``order`` decides which is newer. Equal rows take the source.
    """
    older = F.struct(*(_side("source", c) for c in order)) < F.struct(
        *(_side("target", c) for c in order)
    )
    return {
        c: F.when(older, _side("target", c)).otherwise(_side("source", c)) for c in columns
    }


def _updated(target: DataFrame, set_to: dict[str, Column], hit: Column) -> list[Column]:
    """Target columns in order; assigned ones change where ``hit``, cast to the target type."""
    return [
        F.when(hit, set_to[f.name].cast(f.dataType)).otherwise(_side("target", f.name)).alias(f.name)
        if f.name in set_to
        else _side("target", f.name)
        for f in target.schema.fields
    ]


def _inserted(target: DataFrame, insert: dict[str, Column]) -> list[Column]:
    """Target columns in order; columns without an insert value are null."""
    return [
        insert.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ]


def _packed(columns: Sequence[str]) -> Column:
    """Columns as one struct; a constant where there are none."""
    return F.struct(*map(named, columns)) if columns else F.lit(True)


def _unpacked(columns: Sequence[str]) -> list[Column]:
    return [F.col(_ROW).getField(c).alias(c) for c in columns]


def _one_hit(counted: Column) -> Column:
    """True; fails the query where several source rows hit one target row."""
    message = F.lit("Several source rows match one target row; make the source unique first")
    return F.when(counted > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def upsert(
    target: DataFrame,
    source: DataFrame,
    *,
    on: Sequence[str],
    set: Assignments,
    insert: Assignments,
    hot: HotKeys | None = HotKeys(),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Upsert on equal key columns. Null keys never match, so such source rows are inserted.

    The query fails when two source rows match one target row. Two source rows with the same
    unmatched key are both inserted.

    A source that the optimizer puts at no more than ``broadcast_bytes`` is broadcast, and the target is not
    shuffled. Otherwise each side is shuffled once, into one full outer join. Rows with a hot key, see
    ``HotKeys``, are merged without a shuffle. ``hot=None`` skips the search for hot
    keys, for tables known to have few rows per key.
    """
    keys = list(on)
    if not keys:
        raise ValueError("At least one key is required for an upsert")
    require_columns(target, keys)
    require_columns(source, keys)
    set_to = _assignments(set, target, "set")
    values = _assignments(insert, target, "insert")

    if fits_broadcast(source, broadcast_bytes):
        # No side below is larger than the source.
        return _merge_apart(target, source, keys, set_to, values, F.broadcast)
    hot_keys = hot_values([target, source], keys, hot)
    if hot_keys is None:
        return _merge(target, source, keys, set_to, values)
    cold = [without_hot(t, keys, hot_keys) for t in (target, source)]
    warm = [only_hot(t, keys, hot_keys) for t in (target, source)]
    return _merge(*cold, keys, set_to, values).unionByName(
        _merge_apart(*warm, keys, set_to, values, _stored_side)
    )


def _stored_side(reduced: DataFrame) -> DataFrame:
    """A side with one row per hot key, written; it is broadcast if its files are small enough.

    Beyond that the join shuffles, and since this side is a plain scan, adaptive execution splits the hot keys.
    """
    stored, _ = written(reduced, "reduced")
    return F.broadcast(stored) if fits_broadcast(stored) else stored


def _same_key(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, (_side("target", k) == _side("source", k) for k in keys))


def _merge(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    set_to: dict[str, Column],
    values: dict[str, Column],
) -> DataFrame:
    """One full outer join. Source rows are counted per key in the partitioning of the join."""
    per_key = Window.partitionBy(*map(named, keys))
    counted = source.withColumn(_COUNT, F.count(F.lit(1)).over(per_key))
    marked = target.withColumn(_ROW, F.lit(True))
    joined = marked.alias("target").join(counted.alias("source"), _same_key(keys), "full_outer")
    count = F.col(f"source.{_COUNT}")
    in_target = F.col(f"target.{_ROW}").isNotNull()
    updated, inserted = _updated(target, set_to, count.isNotNull()), _inserted(target, values)
    return joined.filter(F.when(in_target, _one_hit(count)).otherwise(F.lit(True))).select(
        *(
            F.when(in_target, u).otherwise(i).alias(name)
            for u, i, name in zip(updated, inserted, target.columns, strict=True)
        )
    )


def _merge_apart(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    set_to: dict[str, Column],
    values: dict[str, Column],
    side: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Left join to one row per source key, plus an anti join to the target's keys, for few keys.

    ``side`` says how what has one row per key is joined. Where it is broadcast, neither table is shuffled as a whole.
    """
    others = [c for c in source.columns if c not in keys]
    per_key = (
        source.filter(reduce(Column.__and__, (named(k).isNotNull() for k in keys)))
        .groupBy(*map(named, keys))
        .agg(F.count(F.lit(1)).alias(_COUNT), F.first(_packed(others)).alias(_ROW))
        .select(*map(named, keys), *_unpacked(others), _COUNT)
    )
    count = F.col(f"source.{_COUNT}")
    kept = (
        target.alias("target")
        .join(side(per_key).alias("source"), _same_key(keys), "left")
        .filter(_one_hit(count))
        .select(*_updated(target, set_to, count.isNotNull()))
    )
    source_keys = source.select(*map(named, keys)).distinct()
    found = (
        target.select(*map(named, keys))
        .alias("target")
        .join(side(source_keys).alias("source"), _same_key(keys), "left_semi")
    )
    new = (
        source.alias("source")
        .join(side(found.distinct()).alias("target"), _same_key(keys), "left_anti")
        .select(*_inserted(target, values))
    )
    return kept.unionByName(new)


def upsert_where(
    target: DataFrame,
    source: DataFrame,
    *,
    on: Sequence[tuple[str, str]],
    condition: Column,
    target_id: Sequence[str],
    set: Assignments,
    insert: Assignments,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Upsert where rows match on equal columns *and* on a further condition.

    ``on`` lists (target column, source column) pairs that must be equal; ``condition`` is any
    Column over ``target`` and ``source``. ``target_id`` names the columns that identify one
    target row. At least one equality is required: without it every row would have to be
    compared with every other. :func:`upsert_range` matches on a range alone.

    The source is evaluated once, into a scratch table that gives each row a number. Matching pairs come
    from one inner join, which is a broadcast if the numbered source has at most ``broadcast_bytes``, and otherwise
    two plain shuffles, which adaptive execution splits at hot keys on either side. Pairs carry the
    number, so that source rows without a match are told by one column, whatever their copies.
    """
    pairs_on, ids = list(on), list(target_id)
    if not pairs_on:
        raise ValueError("At least one pair of equal columns is required")
    if not ids:
        raise ValueError("target_id must not be empty")
    require_columns(target, [t for t, _ in pairs_on] + ids)
    require_columns(source, [s for _, s in pairs_on])
    set_to = _assignments(set, target, "set")
    values = _assignments(insert, target, "insert")

    columns = source.columns
    numbered, _ = written(source.withColumn(_NUMBER, F.monotonically_increasing_id()), "source")
    equal = [_side("target", t) == _side("source", s) for t, s in pairs_on]
    is_small = fits_broadcast(numbered, broadcast_bytes)
    matches = target.alias("target").join(
        (F.broadcast(numbered) if is_small else numbered).alias("source"),
        reduce(Column.__and__, equal) & condition,
        "inner",
    )
    return _with_matches(target, numbered, matches, ids, columns, set_to, values, is_small)


def _with_matches(
    target: DataFrame,
    numbered: DataFrame,
    pairs: DataFrame,
    ids: list[str],
    columns: list[str],
    set_to: dict[str, Column],
    values: dict[str, Column],
    is_small: bool,
) -> DataFrame:
    """The merged table from ``pairs`` of target rows and numbered source rows that match."""
    matches = pairs.select(
        F.struct(*(_side("target", c).alias(c) for c in ids)).alias(_ID),
        F.struct(*(_side("source", c).alias(c) for c in columns)).alias(_ROW),
        F.col(f"source.{_NUMBER}").alias(_NUMBER),
    )
    # Where this has one row per match, it is all matches; otherwise the query fails. Both uses
    # below need all of its columns, so Spark runs the join above once.
    hits = matches.groupBy(_ID).agg(
        F.count(F.lit(1)).alias(_COUNT), F.first(_ROW).alias(_ROW), F.first(_NUMBER).alias(_NUMBER)
    )
    count = F.col(f"source.{_COUNT}")
    kept = (
        target.withColumn(_ID, F.struct(*map(named, ids)))
        .alias("target")
        .join(
            hits.select(_ID, _COUNT, *_unpacked(columns)).alias("source"),
            F.col(f"target.{_ID}") == F.col(f"source.{_ID}"),
            "left",
        )
        .filter(_one_hit(count))
        .select(*_updated(target, set_to, count.isNotNull()))
    )
    matched = hits.filter(F.col(_ROW).isNotNull() & (F.col(_COUNT) > 0)).select(_NUMBER).distinct()
    new = (
        numbered.alias("source")
        .join(
            (F.broadcast(matched) if is_small else matched).alias("matched"),
            F.col(f"source.{_NUMBER}") == F.col(f"matched.{_NUMBER}"),
            "left_anti",
        )
        .select(*_inserted(target, values))
    )
    return kept.unionByName(new)


def upsert_range(
    target: DataFrame,
    source: DataFrame,
    *,
    point: str,
    low: str,
    high: str,
    target_id: Sequence[str],
    set: Assignments,
    insert: Assignments,
    included: str = "low",
    condition: Column | None = None,
    split: RangeSplit | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Upsert where the target's ``point`` lies between the source's ``low`` and ``high``.

    No equal columns are needed: rows meet in bins, see :func:`tableflow.interval_join`, whose rules for ``included`` bounds,
    nulls, NaN and ``condition`` hold here. ``target_id`` names the columns that identify one target row. The query fails
    where several source rows match one target row; source rows whose range holds no target row are inserted.
    """
    ids = list(target_id)
    if not ids:
        raise ValueError("target_id must not be empty")
    require_columns(target, ids)
    set_to = _assignments(set, target, "set")
    values = _assignments(insert, target, "insert")
    numbered, _ = written(source.withColumn(_NUMBER, F.monotonically_increasing_id()), "source")
    pairs = range_pairs(
        target, numbered, point=point, low=low, high=high, included=included, condition=condition, split=split
    ).pairs
    is_small = fits_broadcast(numbered, broadcast_bytes)
    return _with_matches(target, numbered, pairs, ids, source.columns, set_to, values, is_small)
