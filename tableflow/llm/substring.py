"""Removal of repeated word windows by compaction of a de Bruijn graph.

The graph's nodes are runs of ``window`` - 1 words, and its edges the windows of ``window`` words between
them. An edge is repeated if it starts at two or more places, in one document or several. Words under repeated
edges are removed; all places count, and windows are judged on the input.

1. *Edges in paths.* Every window is dealt by the smallest hash among its runs of ``anchor`` words, its
   anchor. Consecutive windows mostly share one, so a document becomes pieces of paths, some nine
   words to a piece. A piece holds its anchor, its place in the source, and its edges' hashes.
   Equal windows have equal anchors, so they meet in one bucket, wherever they come from.
2. *Within a group of documents* that a task has read, an edge seen twice is known to be repeated at once,
   and only its first place is sent on. So a bucket gets each edge once a group at most, and neither
   a passage that a third of all documents share nor a run of one word fills one task.
3. *Compaction.* In each bucket, neighbouring edges that are repeated are one nonbranching path as far as
   the piece goes, and are sent back as one span of the source instead of edge by edge.
4. *Joins* bring the spans of a source together, where paths that meet at a node become one, and to its
   text, where the words under them are cut.

Words are told apart by 128 bits of BLAKE2b. Two windows count as equal if their 64-bit hashes and those of their anchors are equal; both
are made of all bits of the words' digests. The words of equal windows are not compared again.

Both sides of the last join are shuffled by source, texts once, whatever their size. Groups hold
``group_bytes`` of text or one document.

*Buckets* are held whole, so they must not grow with the input. A sample of ``SAMPLE_SHARE`` of the documents, and of about ``SAMPLE_BYTES`` where
the optimizer says how large the input is, counts the edges and those of each anchor. There are ``per_partition`` buckets to a shuffle partition, and more if
these would hold more than ``bucket_edges`` each. Windows that differ may share an anchor, a phrase of many documents whose hash is
small: anchors that are expected to have more than ``bucket_edges`` edges are dealt by the edges' own hashes, edge by edge. At most ``MAX_HOT`` such anchors, the
hottest, are told to the tasks. The sample only chooses buckets: equal windows meet wherever they are dealt, so results do not depend on it.

Null and empty texts have no words. Null ids are ids like others. Repeated rows are separate sources, so all their
windows are repeated; rows that repeat an id with another text are told apart by a hash of the text.
Other columns stay as they are; one called like the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import (
    covered,
    estimated_bytes,
    free_name,
    hash_texts,
    id_and_text,
    mix,
    need_columns,
    record_batch,
    row_column,
    slices,
    to_arrow,
    window_hashes,
)

WINDOW = 35
ANCHOR = 8
GROUP_BYTES = 1 << 20
PER_PARTITION = 16
BUCKET_EDGES = 500_000
SAMPLE_SHARE = 0.01
SAMPLE_BYTES = 1 << 20
MAX_HOT = 500_000

ANCHORS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("edges", T.LongType())])
PIECES = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("blob", T.BinaryType()),
        T.StructField("id", T.LongType()),
        T.StructField("mark", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
SPANS = T.StructType(PIECES.fields[2:])
CUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("text_left", T.StringType()),
    ]
)

#: of a piece: anchor, source id, whether that is null, mark of the text, place of the first edge, number of edges
_HEAD = np.dtype(
    [("anchor", "<u8"), ("id", "<i8"), ("null", "u1"), ("mark", "<i8"), ("start", "<i4"), ("n", "<i4")]
)


def leftmost_smallest(values: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` values the place of its smallest one, the first if there are several."""
    places = np.arange(len(values))
    width = 1
    while width < size:
        step = min(width, size - width)
        a, b = places[: len(places) - step], places[step:]
        places = np.where(values[b] < values[a], b, a)
        width += step
    return places


def both_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window that both hashes of its words go into."""
    return mix(window_hashes(hashes[0], size) + np.uint64(0x9E3779B97F4A7C15) * window_hashes(hashes[1], size))


def cut_into_pieces(
    hashes: np.ndarray, counts: np.ndarray, window: int, anchor: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of documents whose words' two hashes stand in a row: place, document, anchor's place, hash of each."""
    ends = np.cumsum(counts)
    edges = both_hashes(hashes, window)
    if not len(edges):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, edges
    places = np.arange(len(edges))
    owner = np.searchsorted(ends, places, "right")
    whole = places + window <= ends[owner]
    grams = both_hashes(hashes, anchor)
    at = leftmost_smallest(grams, window - anchor + 1)
    return places[whole], owner[whole], at[whole], edges[whole]


def _first_in_group(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edges are the first of their kind, and which kinds occur more than once."""
    _, first, inverse, counts = np.unique(edges, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(edges), bool)
    is_first[first] = True
    return is_first, counts[inverse] > 1


def _anchor_counts(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different edges each anchor has in a group of texts."""
    hashes, counts = hash_texts(texts)
    _, _, at, edges = cut_into_pieces(hashes, counts, window, anchor)
    is_first, _ = _first_in_group(edges)
    return np.unique(both_hashes(hashes, anchor)[at[is_first]], return_counts=True)


def _is_hot(anchors: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which anchors are among the sorted hot ones."""
    if not len(hot):
        return np.zeros(len(anchors), bool)
    return hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors


def _group_rows(group: list, window: int, anchor: int, buckets: int, hot: np.ndarray) -> Iterator[list]:
    """Rows of ``PIECES`` for a group of (id, text, mark)."""
    hashes, counts = hash_texts([text for _, text, _ in group])
    places, owner, at, edges = cut_into_pieces(hashes, counts, window, anchor)
    if not len(edges):
        return
    begins = np.cumsum(counts) - counts
    is_first, again = _first_in_group(edges)
    for start, end in _runs(again, owner, places):
        i = int(owner[start])
        first = int(places[start] - begins[i])
        bucket = ((group[i][0] or 0) + first) % buckets  # any will do
        yield [bucket, None, group[i][0], group[i][2], first, first + end - start]
    grams = both_hashes(hashes, anchor)
    keep = np.flatnonzero(is_first)
    places, owner, at, edges = places[keep], owner[keep], at[keep], edges[keep]
    new = np.ones(len(edges), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(places) != 1) | (np.diff(owner) != 0)
    alone = _is_hot(grams[at], hot)
    starts = np.flatnonzero(new | alone)
    head = np.zeros(len(starts), _HEAD)
    head["anchor"] = grams[at[starts]]
    ids = np.array([x[0] if x[0] is not None else 0 for x in group], np.int64)
    head["id"], head["null"] = ids[owner[starts]], np.array([x[0] is None for x in group])[owner[starts]]
    head["mark"] = np.array([x[2] for x in group], np.int64)[owner[starts]]
    head["start"] = places[starts] - begins[owner[starts]]
    head["n"] = np.diff(np.append(starts, len(edges)))
    dealt = np.where(alone[starts], mix(edges[starts]), head["anchor"])
    target = ((dealt >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    spread = np.repeat(np.arange(len(starts)), head["n"])
    edge_order = np.argsort(target[spread], kind="stable")
    head, edges = head[order], edges[edge_order]
    used, first, n_pieces = np.unique(target[order], return_index=True, return_counts=True)
    edge_ends = np.cumsum(head["n"])
    for bucket, a, n in zip(used.tolist(), first.tolist(), n_pieces.tolist(), strict=True):
        low, high = int(edge_ends[a] - head["n"][a]), int(edge_ends[a + n - 1])
        blob = n.to_bytes(8, "little") + head[a : a + n].tobytes() + edges[low:high].tobytes()
        yield [bucket, blob, None, None, None, None]


def _runs(flags: np.ndarray, owner: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags that stay in one document and have no gap."""
    if not flags.any():
        return []
    marked = np.flatnonzero(flags)
    new = np.ones(len(marked), bool)
    new[1:] = (np.diff(marked) != 1) | (np.diff(owner[marked]) != 0) | (np.diff(places[marked]) != 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(marked))
    return list(zip(marked[starts].tolist(), (marked[ends - 1] + 1).tolist(), strict=True))


def _bucket_spans(blobs: list[bytes]) -> list:
    """Columns of ``SPANS``: for each piece the runs of edges that occur more than once in the bucket."""
    heads, edges = [], []
    for blob in blobs:
        cut = 8 + int.from_bytes(blob[:8], "little") * _HEAD.itemsize
        heads.append(np.frombuffer(blob[8:cut], _HEAD))
        edges.append(np.frombuffer(blob[cut:], "<u8"))
    head, edge = np.concatenate(heads), np.concatenate(edges)
    piece = np.repeat(np.arange(len(head)), head["n"])
    anchors = head["anchor"][piece]
    order = np.lexsort((anchors, edge))
    same = (np.diff(edge[order]) == 0) & (np.diff(anchors[order]) == 0)
    again = np.zeros(len(edge), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    spans = np.array(_runs(again, piece, np.arange(len(edge))), np.int64).reshape(-1, 2)
    owner = piece[spans[:, 0]]
    begin = np.cumsum(head["n"]) - head["n"]
    start = head["start"][owner] + spans[:, 0] - begin[owner]
    return [
        pa.array(head["id"][owner], pa.int64(), mask=head["null"][owner].astype(bool)),
        pa.array(head["mark"][owner], pa.int64()),
        pa.array(start.astype(np.int32)),
        pa.array((start + spans[:, 1] - spans[:, 0]).astype(np.int32)),
    ]


def _text_groups(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[list]:
    """Rows (id, text, mark) in groups of about ``group_bytes`` of text."""
    group, size = [], 0
    for columns in slices(batches):
        for row_id, text, mark in zip(*columns, strict=True):
            group.append((row_id, text or b"", mark))
            size += len(text or b"")
            if size >= group_bytes:
                yield group
                group, size = [], 0
    if group:
        yield group


def sampled_edges(sources: DataFrame, window: int, anchor: int, group_bytes: int, bucket_edges: int) -> tuple[int, np.ndarray]:
    """About how many edges there are, and the sorted anchors expected to have more than ``bucket_edges``; see above."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(estimated_bytes(sources), 1)))
    schema = to_arrow(ANCHORS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _text_groups(batches, group_bytes):
            anchors, edges = _anchor_counts([text for _, text, _ in group], window, anchor)
            names = pa.array(np.append(anchors, np.uint64(0)).view(np.int64), mask=np.arange(len(anchors) + 1) == len(anchors))
            yield record_batch([names, np.append(edges, edges.sum()).astype(np.int64)], schema)  # the total has no name

    sampled = sources if share == 1.0 else sources.sample(share, seed=1)
    summed = sampled.mapInArrow(count, ANCHORS).groupBy("anchor").agg(F.sum("edges").alias("edges"))
    wanted = summed.where(F.col("anchor").isNull() | (F.col("edges") > bucket_edges * share))
    found = wanted.orderBy(F.desc(F.col("anchor").isNull()), F.desc("edges"), "anchor").limit(1 + MAX_HOT).collect()
    total = sum(row["edges"] for row in found if row["anchor"] is None)
    hot = [row["anchor"] for row in found if row["anchor"] is not None]
    return int(total / share), np.sort(np.array(hot, np.int64).view(np.uint64))


def repeated_spans(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    window: int,
    anchor: int,
    group_bytes: int,
    per_partition: int,
    bucket_edges: int = BUCKET_EDGES,
) -> DataFrame:
    """(id, mark, starts): per source with a repeated window the [start, end) runs of such windows' first words."""
    spark = docs.sparkSession
    sources = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_edges, hot = sampled_edges(sources, window, anchor, group_bytes, bucket_edges)
    buckets = min(max(partitions * per_partition, n_edges // bucket_edges + 1), 2**31 - 1)
    pieces_schema, spans_schema = to_arrow(PIECES), to_arrow(SPANS)

    def emit(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
        batch, size = [], 0
        for row in rows:
            batch.append(row)
            size += len(row[1] or b"") + 40
            if size > 1 << 20:
                yield record_batch(list(zip(*batch, strict=True)), pieces_schema)
                batch, size = [], 0
        if batch:
            yield record_batch(list(zip(*batch, strict=True)), pieces_schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            for group in _text_groups(batches, group_bytes):
                yield from _group_rows(group, window, anchor, buckets, hot)

        return emit(rows())

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, current = [], None
        for batch in batches:
            known = batch.filter(batch.column(1).is_null())
            if known.num_rows:
                yield record_batch([known.column(i) for i in range(2, 6)], spans_schema)
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                blob = batch.column(1)[i].as_py()
                if bucket != current:
                    if blobs:
                        yield record_batch(_bucket_spans(blobs), spans_schema)
                    blobs, current = [], bucket
                if blob is not None:
                    blobs.append(blob)
        if blobs:
            yield record_batch(_bucket_spans(blobs), spans_schema)

    pieces = sources.mapInArrow(deal, PIECES).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    spans = pieces.mapInArrow(compact, SPANS)
    return spans.groupBy("id", "mark").agg(F.collect_list(F.array("start", "end")).alias("starts"))


def _cutter(window: int, with_text: bool) -> Callable[[], Callable[..., tuple]]:
    def make() -> Callable[..., tuple]:
        def row(text: bytes | None, starts: list | None) -> tuple:
            text = text or b""
            words = text.split()
            n = len(words)
            if starts:
                marks = np.concatenate([np.arange(a, b) for a, b in starts])
                gone = covered(np.unique(marks), window, n)
                kept = [word for word, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                kept = words
            joined = b" ".join(kept)
            digest = hashlib.sha256(joined).hexdigest()
            left = None
            if with_text:
                left = (text if len(kept) == n else _without(text, words, gone)).decode("utf-8", "replace")
            return n, n - len(kept), digest, left

        return row

    return make


def _without(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without words that are gone and the white space after each."""
    out, at = [], 0
    for word, g in zip(words, gone.tolist(), strict=True):
        start = text.index(word, at)
        if not g:
            out.append(text[at:start] if out else b"")
            out.append(word)
        at = start + len(word)
    return b"".join(out)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    with_text: bool = False,
    into: str = "cut",
    group_bytes: int = GROUP_BYTES,
    per_partition: int = PER_PARTITION,
    bucket_edges: int = BUCKET_EDGES,
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_removed, kept_sha256 and, ``with_text``, text_left.

    ``text_left`` is the text as it is if nothing is removed; else the kept words, each with the white
    space that stands before it.
    """
    need_columns(docs, id_col, text_col)
    if anchor > window:
        raise ValueError("The anchor is longer than the window")
    spans = repeated_spans(docs, id_col, text_col, window, anchor, group_bytes, per_partition, bucket_edges)
    key, starts = free_name(docs, "source_key"), free_name(docs, "window_starts")
    spans = spans.select(
        F.struct(F.col("id").alias("i"), F.col("mark").alias("m")).alias(key), F.col("starts").alias(starts)
    )
    text = F.col(f"`{text_col}`").cast("binary")
    source = F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("m"))
    joined = docs.withColumn(key, source).join(spans, key, "left")
    cut = row_column(_cutter(window, with_text), CUT)(text, F.col(starts))
    return joined.withColumn(into, cut).drop(key, starts)
