"""What the operators share: walking over texts inside a task, and hashes of words.

Words are those between ASCII white space unless an operator says otherwise. Texts are handled as
UTF-8 bytes: splitting, lower-casing of A-Z and hashing are then the same on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS = 64
BLOCK_BYTES = 1 << 20

WHITE_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need_columns(df: DataFrame, *names: str) -> None:
    """Raise if a column that an operator reads is missing."""
    if missing := [name for name in names if name not in df.columns]:
        raise ValueError(f"Missing columns: {', '.join(missing)}")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that a text operator reads, whatever others there are."""
    need_columns(df, id_col, text_col)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[tuple]:
    """Lists of the columns' values, a few rows at a time, so that copies stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield tuple(part.column(i).to_pylist() for i in range(part.num_columns))
        del batch
        pa.default_memory_pool().release_unused()


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., Sequence | None]], schema: T.StructType
) -> DataFrame:
    """One output row for each input row. ``make`` runs once per task and returns the row function.

    The function gets a row's values and returns the values of ``schema``, or None for no row.
    """
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for columns in slices(batches):
            made = [r for r in map(row, *columns) if r is not None]
            if made:
                yield record_batch(list(zip(*made, strict=True)), arrow)

    return df.mapInArrow(run, schema)


def row_column(make: Callable[[], Callable[..., Sequence]], schema: T.StructType) -> Callable[..., Column]:
    """A function of columns that gives a struct of ``schema`` for each row, beside any other columns.

    ``make`` runs once per task, on the first batch, and returns the row function.
    """
    fields = list(to_arrow(schema))
    made: list[Callable[..., Sequence]] = []

    def run(*arrays: pa.Array) -> pa.Array:
        if not made:
            made.append(make())
        parts = [_structs([], fields)]
        for start in range(0, len(arrays[0]), SLICE_ROWS):
            rows = map(made[0], *(x.slice(start, SLICE_ROWS).to_pylist() for x in arrays))
            parts.append(_structs(list(zip(*rows, strict=True)), fields))
        joined = pa.concat_arrays(parts)
        del parts
        pa.default_memory_pool().release_unused()
        return joined

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema).asNondeterministic()  # or a filter on it would run it twice


def _structs(columns: list, fields: list[pa.Field]) -> pa.StructArray:
    columns = columns or [[] for _ in fields]
    return pa.StructArray.from_arrays(
        [pa.array(x, type=f.type) for x, f in zip(columns, fields, strict=True)], fields=fields
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it until no column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``; rows without an id stay.

    ``ids`` is evaluated twice, so it should be a stored table. It is broadcast if it has at most ``broadcast_ids`` rows.
    """
    name = free_name(docs, "dropped_id")
    ids = ids.toDF(name)
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def to_arrow(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def record_batch(columns: Sequence[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema`` from one list or array per column."""
    arrays = [
        x if isinstance(x, pa.Array) else pa.array(x, type=field.type)
        for x, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# Hashes ---------------------------------------------------------------------------------------
#
# A word's hash is cut from its BLAKE2b digest, so that words that were made to collide don't. The hash of a window of words is
# a sum of their hashes, each times a number that belongs to its place in the window, passed through a mixing function. Equal strings
# have equal hashes; the operators that rest on unequal hashes for unequal strings say how they verify.

_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)

#: Windows of more words are hashed by running sums over powers of a base instead of place by place.
_PLACES = 64

#: Words whose digests a worker remembers, and the longest of them.
_REMEMBERED, _SHORT = 1 << 15, 64
_digests: dict[bytes, bytes] = {}


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a base and of its inverse, kept for the longest run asked for so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, _inverse(base)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_WORDS = Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(1, _PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _digest(word: bytes) -> bytes:
    """16 bytes of BLAKE2b."""
    found = _digests.get(word)
    if found is None:
        found = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= _SHORT:
            if len(_digests) >= _REMEMBERED:
                _digests.clear()
            _digests[word] = found
    return found


def word_digests(text: bytes) -> np.ndarray:
    """Two 64-bit hashes for each word of a text, one row each; words are split ``BLOCK_BYTES`` at a time."""
    parts, start = [], 0
    while start < len(text):
        end = min(len(text), start + BLOCK_BYTES)
        while end < len(text) and text[end] not in WHITE_SPACE:
            end += 1
        parts.append(b"".join(map(_digest, text[start:end].split())))
        start = end
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text."""
    return word_digests(text)[:, 0].copy()


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each window of ``size`` consecutive word hashes."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    if size <= _PLACES:
        out = words[:n] * _PLACE[0]
        for place in range(1, size):
            out += words[place : place + n] * _PLACE[place]
        return mix(out)
    up, down = _WORDS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def hash_texts(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of the words of several texts in a row, one column a word, and the number of words of each."""
    parts = [word_digests(text) for text in texts]
    joined = np.concatenate([np.empty((0, 2), np.uint64), *parts])
    return np.ascontiguousarray(joined.T), np.array([len(x) for x in parts], np.int64)


def covered(starts: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window of ``size`` words that begins at a start."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.subtract.at(marks, np.minimum(starts + size, n_words), 1)
    return np.cumsum(marks[:n_words]) > 0


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """The (start, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
