"""Benchmark decontamination with a broadcast hash set of n-grams.

Test items and documents are normalised alike: A-Z lower-cased, words are runs of digits, letters
a-z and non-ASCII characters. The windows of an item are its runs of ``size`` consecutive words, or
all its words if there are fewer. A document word inside any occurrence of a window is hit.

The test windows go to every task as hash sets, with the windows' words for verification. Their size
is checked first: items are dealt into blocks of at most ``block_bytes`` of text, and each block scans
all documents. One block, the usual case, needs no shuffle at all; with more, the hit spans of
the blocks, which only documents with hits have, are joined to the documents by a hash of the text.

Null and empty texts have no words. Items without words match nothing. Repeated items are separate
items with their own ids. Null item ids are left out of the list of ids but their windows hit.
Repeated rows give repeated results. Other columns, nulls among them, stay as they are; one called like
the result is replaced. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import (
    covered,
    free_name,
    id_and_text,
    mix,
    need_columns,
    row_column,
    runs,
    window_hashes,
)
from tableflow.sources.scratch import written

WINDOW = 13
BLOCK_BYTES = 16 << 20


def _normal_bytes() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    lowered = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if b in keep else 0x20 for b in lowered)


_NORMAL = _normal_bytes()


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


@dataclass
class NgramSet:
    """The windows of a block of items: word numbers, all items' words in a row, and by length the
    windows' sorted hashes with the place and item of each."""

    numbers: dict[bytes, int]
    words: np.ndarray
    item_ids: list[int | None]
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build_ngrams(items: Iterable[tuple[int | None, bytes | None]], size: int) -> NgramSet:
    """Number the words of the items and hash their windows: some 20 bytes a window."""
    numbers: dict[bytes, int] = {}
    item_ids, words, at = [], [np.empty(0, np.int32)], 0
    made: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for item_id, text in items:
        ids = np.array([numbers.setdefault(word, len(numbers) + 1) for word in _words(text)], np.int32)
        step = min(size, len(ids))
        if step:
            hashes = window_hashes(mix(ids.astype(np.uint64)), step)
            places = np.arange(at, at + len(hashes))
            made.setdefault(step, []).append((hashes, places, np.full(len(hashes), len(item_ids))))
        item_ids.append(item_id)
        words.append(ids)
        at += len(ids)
    by_size = {}
    for step, parts in made.items():
        hashes, places, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        by_size[step] = hashes[order], places[order], owners[order]
    return NgramSet(numbers, np.concatenate(words), item_ids, by_size)


def _hits(text: bytes | None, tests: NgramSet) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, which of them are hit, and the items with occurring windows."""
    words = _words(text)
    n = len(words)
    flags = np.zeros(n, bool)
    items: set[int] = set()
    if not n or not tests.by_size:
        return n, flags, items
    get = tests.numbers.get
    ids = np.fromiter((get(word, 0) for word in words), np.int32, n)
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    for size, (hashes, places, owners) in tests.by_size.items():
        whole = np.flatnonzero(known[size:] - known[:-size] == size) if n >= size else []
        if not len(whole):
            continue
        found = []
        for start, end in _spans(whole, size):
            part = window_hashes(mix(ids[start:end].astype(np.uint64)), size)
            first = np.searchsorted(hashes, part, "left")
            last = np.searchsorted(hashes, part, "right")
            for i in np.flatnonzero(last > first).tolist():
                window = ids[start + i : start + i + size]
                for j in range(first[i], last[i]):
                    if np.array_equal(tests.words[places[j] : places[j] + size], window):
                        found.append(start + i)
                        items.add(tests.item_ids[owners[j]])
        if found:
            flags |= covered(np.unique(found), size, n)
    items.discard(None)
    return n, flags, items


def _spans(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Word spans that hold the windows beginning at ``starts``."""
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    for group in np.split(starts, cuts):
        yield int(group[0]), int(group[-1]) + size


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        *HITS.fields[1:],
    ]
)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``block_bytes`` of text (one item at least), one block at a time."""
    block, size = [], 0
    for row in id_and_text(benchmark, item_col, text_col).toLocalIterator(prefetchPartitions=False):
        n = len(row["text"] or b"")
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["id"], bytes(row["text"] or b"")))
        size += n
    yield block


def _finish(n_words: int, spans: list, items: Iterable[int], min_share: int) -> tuple:
    n_hit = sum(end - start for start, end in spans)
    listed = sorted(items)
    digest = hashlib.sha256(",".join(sorted(map(str, listed))).encode()).hexdigest()
    return n_words, n_hit, len(listed), digest, n_hit > 0 and min_share * n_hit >= n_words, spans, listed


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    min_share: int = 20,
    block_bytes: int = BLOCK_BYTES,
    into: str = "tests",
) -> DataFrame:
    """``docs`` with a struct column ``into``: words, hit words, items, and whether it is contaminated.

    Contaminated: at least one word is hit, and ``min_share`` times the hit words reach all words.
    ``spans`` are the [start, end) word positions of the hits, for removing spans instead of documents.
    """
    need_columns(docs, text_col)
    text = F.col(f"`{text_col}`").cast("binary")
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    parts: list[DataFrame] = []
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        sent = spark.sparkContext.broadcast(build_ngrams(block, size))
        if not parts and after is None:
            return docs.withColumn(into, row_column(_scanner(sent, min_share), RESULT)(text))
        hits = row_column(_partial(sent), HITS)
        part = docs.select(F.sha2(text, 256).alias("key"), hits(text).alias("h")).select("key", "h.*")
        parts.append(written(part.where("size(spans) > 0").dropDuplicates(["key"]), "hits")[0])
        block = after
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    key, found = free_name(docs, "text_key"), free_name(docs, "found_hits")
    merged = together.groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    merged = merged.select(F.col("key").alias(key), F.struct("spans", "items").alias(found))
    joined = docs.withColumn(key, F.sha2(text, 256)).join(merged, key, "left")
    return joined.withColumn(into, row_column(_merger(min_share), RESULT)(text, F.col(found))).drop(key, found)


def _scanner(sent, min_share: int) -> Callable[[], Callable[..., tuple]]:
    def make() -> Callable[..., tuple]:
        tests = sent.value

        def row(text: bytes | None) -> tuple:
            n, flags, items = _hits(text, tests)
            return _finish(n, runs(flags), items, min_share)

        return row

    return make


def _partial(sent) -> Callable[[], Callable[..., tuple]]:
    def make() -> Callable[..., tuple]:
        tests = sent.value

        def row(text: bytes | None) -> tuple:
            n, flags, items = _hits(text, tests)
            return n, runs(flags), sorted(items)

        return row

    return make


def _merger(min_share: int) -> Callable[[], Callable[..., tuple]]:
    def make() -> Callable[..., tuple]:
        def row(text: bytes | None, found: dict | None) -> tuple:
            found = found or {"spans": [], "items": []}
            return _finish(len(_words(text)), _union(found["spans"]), found["items"], min_share)

        return row

    return make


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out
