"""Near-duplicate documents by min-max hashing, with links confirmed on the full shingle sets.

A document's set holds its distinct runs of ``shingle`` words (A-Z lower-cased, split at ASCII white space);
with fewer words, the whole sequence is the one member. Documents are linked whose sets have a
Jaccard similarity of at least ``percent`` / 100.

1. *Signatures.* Both the smallest and the largest value under each of 64 random permutations of the
   shingles are kept: 128 values from 64 hash evaluations a shingle. Four values make a band, so
   that there are 32 bands; a pair at the limit of 0.85 misses all of them with a probability below 1e-10.
2. *Classes.* Documents of equal word sequences are one class, led by its smallest id. Only leaders go on.
3. *Stars.* Leaders with an equal band share a bucket. A bucket is never expanded into all pairs: its members are
   compared with its hub only, the one that meets the most other leaders in all its buckets.
4. *Rest.* A bucket whose members are then still in different components may hide links between them. Every such link
   has an end outside the bucket's largest component. For these ends the prefix filter gives all possible
   partners: two sets that reach the limit share at least one of the rarest shingles of each, as many as the two sizes
   leave room for. Shingles shared by a whole group are not among the rarest of those that differ too much from its hub, so pairs
   without a link hardly ever come up. Nothing is lost here, whatever the size of a group.
5. *Confirmation* reads the whole texts of candidate pairs and compares exact sets.
6. *Components* of the confirmed links give each document its group and the one that is kept.

Broadcast are only the ids of candidates, if there are at most ``broadcast_ids``; otherwise the
join shuffles. Texts of non-candidates are not shuffled in the first case. Everything between the steps
is written below the shared folder and dropped when it is no longer read.

Null and blank texts have an empty set and are linked with nothing. Rows without an id are linked with nothing and
kept. Repeated rows get equal results; rows that repeat an id with another text are judged by their
own text, and links of that id are those of either text. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import (
    id_and_text,
    map_rows,
    mix,
    record_batch,
    slices,
    to_arrow,
    window_hashes,
    word_hashes,
)
from tableflow.llm.components import connected_components
from tableflow.sources.scratch import Scratch, drop_scratch, written

SHINGLE = 3
PERCENT = 85
PERMUTATIONS = 64
BAND_ROWS = 4
BROADCAST_IDS = 1_000_000

_SEED = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_MULTIPLY = (_SEED[:PERMUTATIONS] | np.uint64(1))[None, :]
_ADD = _SEED[PERMUTATIONS:][None, :]
_BANDS = 2 * PERMUTATIONS // BAND_ROWS
_COMBINE = (mix(np.arange(1000, 1000 + 2 * PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)).reshape(_BANDS, BAND_ROWS)
_BLOCK = 1024


def shingles(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The full set of a text."""
    words = text.lower().split()
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def similar(a: set, b: set, percent: int) -> bool:
    """Whether two sets reach the limit; empty sets never do."""
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def bands(hashes: np.ndarray) -> list[int]:
    """The bands of a set of shingle hashes: four minima or four maxima each."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(hashes), _BLOCK):
        values = hashes[start : start + _BLOCK, None] * _MULTIPLY + _ADD
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    signature = mix(np.concatenate((low, high))).reshape(_BANDS, BAND_ROWS)
    return mix((signature * _COMBINE).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()


SIGNED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _signer(size: int) -> Callable[[], Callable[[int | None, bytes | None], tuple]]:
    def make() -> Callable[[int | None, bytes | None], tuple]:
        def row(doc_id: int | None, text: bytes | None) -> tuple:
            lowered = (text or b"").lower()
            words = word_hashes(lowered)
            if not len(words):
                return doc_id, 0, f"empty {doc_id}".encode(), None
            unique = np.unique(window_hashes(words, min(size, len(words))))
            key = hashlib.md5(b" ".join(lowered.split()), usedforsecurity=False).digest()
            return doc_id, len(unique), key, None if doc_id is None else bands(unique)

        return row

    return make


VERIFIED = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType())]
)


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs, on the full sets; ``b`` is the member that many pairs share."""
    schema = to_arrow(VERIFIED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 32):
                a, b, text_a, text_b = (batch.slice(start, 32).column(i).to_pylist() for i in range(4))
                linked = []
                for i in range(len(a)):
                    if last != text_b[i]:
                        last, last_set = text_b[i], shingles(text_b[i], size)
                    linked.append(similar(shingles(text_a[i], size), last_set, percent))
                yield record_batch([a, b, linked], schema)

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, VERIFIED)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept (it is the smallest id of its group)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = id_and_text(docs, id_col, text_col)
    signed, _ = written(map_rows(source, _signer(shingle), SIGNED), "signed")

    # What was aggregated is stored before it is joined: only then can Spark split a hot key of the join.
    leaders = scratch.keep(
        signed.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("leader")), "leaders"
    )
    classed, _ = written(
        signed.where("id IS NOT NULL")
        .join(leaders, "key")
        .select("id", "n", "leader", F.when(F.col("id") == F.col("leader"), F.col("bands")).alias("bands")),
        "classed",
    )
    buckets = scratch.keep(_buckets(classed, scratch), "buckets")

    candidates = scratch.keep(buckets.select("id").distinct(), "ids")
    few = candidates.count() <= broadcast_ids
    wanted = F.broadcast(candidates) if few else candidates
    texts = scratch.keep(source.where("id IS NOT NULL").join(wanted, "id", "left_semi").distinct(), "texts")

    tested = scratch.keep(_verify(_star_pairs(buckets, scratch), texts, shingle, percent), "tested")
    labels, labels_path = connected_components(tested.where("linked"))
    tokens = scratch.keep(_tokens(_mixed(buckets, labels, scratch), texts, shingle), "tokens")
    rest = _prefix_pairs(tokens, percent, scratch).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = scratch.keep(_verify(rest, texts, shingle, percent), "found")
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    all_labels, _ = connected_components(known.unionByName(found.where("linked").select("a", "b")))
    scratch.drop()
    drop_scratch(spark, labels_path)

    ided = classed.join(all_labels.withColumnRenamed("id", "leader"), "leader", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "leader").alias("component_id")
    )
    without = signed.where("id IS NULL").select(
        "id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return ided.unionByName(without).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _buckets(classed: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, id, size) for leaders that share a band with another leader; size: how many share it."""
    exploded = classed.where("bands IS NOT NULL").select(
        F.posexplode("bands").alias("band", "value"), F.col("leader").alias("id")
    )
    rows = exploded.select(F.xxhash64("band", "value").alias("h"), "id")
    shared = (
        rows.groupBy("h")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size"))
        .where("first <> last")
    )
    return rows.join(scratch.keep(shared.select("h", "size"), "shared"), "h")


def _star_pairs(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """Each member with the hub of its bucket; of equally met leaders the smallest id is the hub."""
    degrees = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = buckets.join(degrees, "id").select("h", "id", F.struct("degree", (-F.col("id")).alias("low")).alias("rank"))
    hubs = ranked.groupBy("h").agg(F.max("rank").alias("most")).select("h", (-F.col("most.low")).alias("hub"))
    pairs = buckets.select("h", "id").join(scratch.keep(hubs, "hubs"), "h").where("id <> hub")
    return pairs.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def _mixed(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component, outside) for members of buckets with several components; outside: of the largest one."""
    rows = buckets.join(labels, "id", "left").select("h", "id", F.coalesce("component", "id").alias("component"))
    sizes = rows.groupBy("h", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("h").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("k"))
    members = rows.join(scratch.keep(mixed.where("k > 1"), "mixed"), "h")
    outside = F.max((F.col("component") != F.col("most.component")).cast("int"))
    return members.groupBy("id", "component").agg((outside == 1).alias("outside"))


TOKENS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("component", T.LongType()),
        T.StructField("outside", T.BooleanType()),
        T.StructField("n", T.LongType()),
        T.StructField("token", T.LongType()),
    ]
)


def _tokens(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """A row for each shingle hash of the members. Equal hashes of unequal shingles only add partners."""
    schema = to_arrow(TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches, 64):
            for doc_id, component, outside, text in zip(*columns, strict=True):
                words = word_hashes(text.lower())
                hashes = np.unique(window_hashes(words, min(size, len(words)))).view(np.int64)
                n = len(hashes)
                yield record_batch(
                    [np.full(n, doc_id), np.full(n, component), np.full(n, outside), np.full(n, n), hashes], schema
                )

    return texts.join(members, "id").select("id", "component", "outside", "text").mapInArrow(run, TOKENS)


def _prefix_pairs(tokens: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components, one of them outside, that share one of the rarest shingles of both."""
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    # the partner with the fewest shingles that can reach the limit leaves the most room
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = tokens.join(scratch.keep(frequency, "frequency"), "token").withColumn("rank", rank)
    rare = scratch.keep(ranked.where((F.col("rank") <= room) & (F.col("df") > 1)), "rare")
    p, q = rare.where("outside").alias("p"), rare.alias("q")
    common = F.ceil((F.col("p.n") + F.col("q.n")) * percent / (100 + percent))
    fits = (
        (F.col("p.token") == F.col("q.token"))
        & (F.col("p.component") != F.col("q.component"))
        & (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n"))
        & (F.col("p.rank") <= F.col("p.n") - common + 1)
        & (F.col("q.rank") <= F.col("q.n") - common + 1)
    )
    pairs = p.join(q, fits)
    return pairs.select(F.greatest("p.id", "q.id").alias("a"), F.least("p.id", "q.id").alias("b")).distinct()
