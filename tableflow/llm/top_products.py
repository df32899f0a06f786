"""The rows with the largest inner products, exactly, from vectors sorted by length.

1. **Index.** Components become whole numbers, ``floor(scale * x)``; rows are sorted by descending length over all tasks and
   written once. A partition holds neighbours in that order, and equal lengths are split by row number.
2. **Rotation.** The right singular vectors of a bounded sample of rows (``FIT_ROWS``) turn all vectors, so that the first coordinates
   hold most of a product. They change the speed only: an orthogonal turn keeps every product.
3. **Floors.** Each query is compared with the ``HEAD_ROWS`` longest vectors; its k-th best score there is a floor for the answer.
4. **Search.** Queries go to the tasks in blocks of at most ``BLOCK_BYTES``, a scan of the index for each. Within a task rows come by
   descending length. A query is done with a batch where its length times theirs falls below its floor (Cauchy-Schwarz). Partial sums over
   the first rotated coordinates, plus the product of the lengths of the rest, drop pairs slice by slice. What is left
   is scored in whole numbers, and raises the floor.
5. A task hands on at most k rows a query; ranks over those give the answer.

Pruning is by bounds with a margin for rounding, so no answer is lost; rows with equal scores are all looked at before ids decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import need_columns, record_batch, to_arrow
from tableflow.sources.scratch import Scratch, written

#: Rows that the rotation is fitted to, and longest rows that give the first floors; both go through the driver.
FIT_ROWS, HEAD_ROWS = 4_096, 4_096
#: Bytes of query vectors that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Rows of a partition of the index.
PARTITION_ROWS = 32_768
#: Shares of the sample's squared lengths that the slices of rotated coordinates reach.
SLICES = (0.35, 0.6, 0.8)

_QUERY_GROUP, _CANDIDATES = 256, 4_096
_EXACT = float(1 << 53)
_NONE = -(1 << 63)

_FOUND = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("query_row", "query_id", "score", "found_row", "vec_id")]
)


@dataclass
class Rotation:
    """An orthogonal turn of vectors of ``width`` components, and where its slices end."""

    width: int
    turn: np.ndarray
    ends: list[int]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.turn


def fit_rotation(sample: np.ndarray, width: int) -> Rotation:
    """Right singular vectors of the sample, by descending singular value (from its product with itself)."""
    squares, vectors = np.linalg.eigh(sample.T @ sample)
    energy = np.maximum(squares[::-1], 0.0)
    share = np.cumsum(energy) / max(energy.sum(), 1.0)
    ends = sorted({min(int(np.searchsorted(share, x)) + 1, width) for x in SLICES} - {width})
    return Rotation(width, vectors[:, ::-1].copy(), ends)


def padded(vectors: pa.Array, width: int) -> np.ndarray:
    """A matrix of lists of numbers, shorter ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray, safe: bool) -> np.ndarray:
    """Row by row the inner products of two matrices of whole numbers; beyond 64 bits the nearest long."""
    if safe:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    low, high = _NONE + 1, (1 << 63) - 1
    exact = (sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a.tolist(), b.tolist(), strict=True))
    return np.array([min(max(x, low), high) for x in exact], np.int64)


class Best:
    """The k best (score, id, row) of each of some queries; a floor below which nothing matters."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.k, self.floors = k, floors.copy()
        self.query = np.empty(0, np.int64)
        self.score, self.ids, self.rows = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in further pairs; ids are already in the form that sorts nulls last."""
        if not len(query):
            return
        touched = np.zeros(len(self.floors), bool)
        touched[query] = True
        mine = touched[self.query]
        parts = [np.concatenate([old[mine], new]) for old, new in zip(self._all(), (query, score, ids, rows), strict=True)]
        order = np.lexsort((parts[3], parts[2], -1 - parts[1], parts[0]))  # -1 - x turns the order of longs around
        parts = [x[order] for x in parts]
        first = np.searchsorted(parts[0], parts[0], "left")
        place = np.arange(len(first)) - first
        last = place == self.k - 1
        self.floors[parts[0][last]] = np.maximum(self.floors[parts[0][last]], parts[1][last])
        keep = place < self.k
        self.query, self.score, self.ids, self.rows = (
            np.concatenate([old[~mine], new[keep]]) for old, new in zip(self._all(), parts, strict=True)
        )

    def _all(self) -> tuple[np.ndarray, ...]:
        return self.query, self.score, self.ids, self.rows


@dataclass
class Queries:
    """A block of queries: rows, ids, whole-number vectors, lengths and floors, by descending length."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    floors: np.ndarray


_LAST = (1 << 63) - 1  # stands for a null id, which sorts last


def _tails(turned: np.ndarray, ends: list[int]) -> list[np.ndarray]:
    """The lengths of what is left of each vector after each slice."""
    return [np.sqrt(np.square(turned[:, end:]).sum(axis=1)) for end in ends]


def search(
    queries: Queries, turn: Rotation, best: Best, vectors: np.ndarray, lengths: np.ndarray, ids: np.ndarray, rows: np.ndarray,
    turned_queries: np.ndarray, query_tails: list[np.ndarray],
) -> None:
    """Take the candidates of one batch, by descending length, into ``best``."""
    turned = turn(vectors)
    tails = _tails(turned, turn.ends)
    for q0 in range(0, len(queries.rows), _QUERY_GROUP):
        q = slice(q0, q0 + _QUERY_GROUP)
        size = queries.lengths[q]
        margin = 0.5 + 1e-9 * size * lengths[0]
        need = best.floors[q] - margin
        reach = size[:, None] * lengths[None, :] >= need[:, None]
        n = int(reach.any(axis=0).sum())  # lengths fall, so these are the first n
        if not n:
            continue
        safe = float(size.max(initial=0.0)) * float(lengths[0]) < _EXACT
        i, j = _survivors(turned_queries[q], turned[:n], [x[q] for x in query_tails], [x[:n] for x in tails], turn.ends, reach[:, :n], need)
        own = queries.rows[q][i] == rows[j]
        i, j = i[~own], j[~own]
        for start in range(0, len(i), 1 << 16):
            a, b = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            score = products(queries.vectors[q][a], vectors[b], safe)
            good = score >= best.floors[q][a] - margin[a]
            best.add(a[good] + q0, score[good], ids[b[good]], rows[b[good]])


def _survivors(
    queries: np.ndarray, candidates: np.ndarray, query_tails: list, tails: list, ends: list[int], reach: np.ndarray, need: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs whose partial sums do not rule them out."""
    if not ends:
        return np.nonzero(reach)
    partial = queries[:, : ends[0]] @ candidates[:, : ends[0]].T
    alive = reach & (partial + query_tails[0][:, None] * tails[0][None, :] >= need[:, None])
    i, j = np.nonzero(alive)
    sums = partial[i, j]
    for step in range(1, len(ends)):
        cut = slice(ends[step - 1], ends[step])
        sums = sums + np.einsum("ij,ij->i", queries[i, cut], candidates[j, cut])
        good = sums + query_tails[step][i] * tails[step][j] >= need[i]
        i, j, sums = i[good], j[good], sums[good]
    return i, j


def _searcher(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = to_arrow(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, turn, k = sent.value
        best = Best(queries.floors, k)
        turned_queries = turn(queries.vectors)
        query_tails = _tails(turned_queries, turn.ends)
        for batch in batches:
            for start in range(0, batch.num_rows, _CANDIDATES):
                row, ids, vectors, length = batch.slice(start, _CANDIDATES).columns
                ids = ids.fill_null(_LAST).to_numpy()
                matrix, length = padded(vectors, turn.width), length.to_numpy()
                order = np.argsort(-length, kind="stable")  # a reader may have joined files
                search(queries, turn, best, matrix[order], length[order], ids[order], row.to_numpy()[order], turned_queries, query_tails)
        ids = pa.array(best.ids, mask=best.ids == _LAST)
        yield record_batch([queries.rows[best.query], queries.ids[best.query], best.score, best.rows, ids], arrow)

    return run


def _floor_column(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the floor of each query from the longest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_rows, head, head_lengths, k = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, _QUERY_GROUP):
                part = batch.slice(start, _QUERY_GROUP)
                rows, vectors = part.column(0).to_numpy(), padded(part.column(2), head.shape[1])
                # rounding below the margin of the search
                scores = vectors @ head.T
                scores[rows[:, None] == head_rows[None, :]] = -np.inf
                floors = np.full(len(rows), -np.inf)
                if len(head_rows) >= k:
                    floors = np.partition(scores, len(head_rows) - k, axis=1)[:, len(head_rows) - k]
                slack = 1e-9 * part.column(3).to_numpy() * head_lengths.max(initial=0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floors - slack)], [*part.schema.names, "floor"])

    return run


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return padded(pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *(x.cast(pa.list_(pa.float64())) for x in table.column("v").chunks)]), width)


def whole_vector(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component, at most the limits of a long; null for a vector that takes no part."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = vector.cast("array<double>")
    whole = F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    return F.when(F.forall(doubles, ok), whole)


def top_products(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: float = 1024.0,
    block_bytes: int = BLOCK_BYTES,
    partition_rows: int = PARTITION_ROWS,
) -> tuple[DataFrame, str]:
    """(query_id, rank, vec_id, score) of the k best other rows for each row where ``is_query``, and the scratch folder that holds them.

    Ids are whole numbers. The score is the inner product of the whole-number vectors, ties go to the smaller id, then to
    the row that comes first. Vectors that are null or hold a null or a non-finite component take no part. Of vectors with different
    numbers of components the shorter is filled up with zeros. Rows that repeat an id are rows of their own: each is a
    query if its id is one, and a candidate for all others. A null id is a candidate, last among equals. Fewer than k other rows are all returned; an empty
    table, or one without queries, gives no rows. Further columns, whatever their names, are not read.
    """
    need_columns(vectors, id_col, vector_col)
    if k < 1:
        raise ValueError("k must be at least 1")
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise ValueError("Ids must be whole numbers")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), is_query.alias("q"), whole_vector(F.col(f"`{vector_col}`"), scale).alias("v")
    )
    rows = rows.where("v IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "id", "v", length.alias("length"), F.coalesce("q", F.lit(False)).alias("q")
    )
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if("q").alias("queries")).first()
    by_length = [F.col("length").desc(), F.col("row").asc()]
    ranged = rows.repartitionByRange(max(1, -(-size["n"] // partition_rows)), *by_length)
    index = scratch.keep(ranged.sortWithinPartitions(*by_length), "index")
    width, columns = max(size["width"] or 0, 1), ["row", "id", "v", "length"]

    sample = index.orderBy(F.xxhash64("row"), "row").limit(FIT_ROWS).select("v").toArrow()
    turn = fit_rotation(_matrix(sample, width), width)
    head = index.orderBy(*by_length).limit(HEAD_ROWS).select("row", "v", "length").toArrow()
    sent = spark.sparkContext.broadcast((_numbers(head, "row"), _matrix(head, width), _numbers(head, "length"), k))
    n_blocks = max(1, -(-size["queries"] * width * 8 // block_bytes))
    floors = index.where("q").select(*columns).mapInArrow(_floor_column(sent), "row long, id long, v array<double>, length double, floor double")
    floors = scratch.keep(floors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))), "queries")

    found = []
    for block in range(n_blocks):
        mine = floors.where(F.col("block") == block).toArrow().sort_by([("length", "descending"), ("row", "ascending")])
        if not mine.num_rows:
            continue
        row, ids, lengths, least = (_numbers(mine, x) for x in ("row", "id", "length", "floor"))
        queries = Queries(row, ids, _matrix(mine, width), lengths, least)
        block_sent = spark.sparkContext.broadcast((queries, turn, k))
        found.append(scratch.keep(index.select(*columns).mapInArrow(_searcher(block_sent), _FOUND), "found"))
        block_sent.unpersist()
    together = spark.createDataFrame([], _FOUND)
    for part in found:
        together = together.unionByName(part)
    place = F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("found_row"))
    )
    ranked = together.withColumn("rank", place).where(F.col("rank") <= k)
    result, path = written(ranked.select("query_id", "rank", "vec_id", "score"), "top_products")
    scratch.drop()
    return result, path
