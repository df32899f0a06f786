"""Quality scores from random-indexing vectors and a small network with calibrated probabilities.

*Tokens.* Words in lower case and runs of signs, each in one of ``BUCKETS`` buckets by its hash. Marks are put in
for a word in capitals, a word equal to the one before, and the end of a line, so that these have vectors too.

*Random indexing.* Each bucket has a sparse random index vector of +1 and -1. Its context vector is the sum of
the index vectors of its neighbours, ``REACH`` tokens to each side, over all documents. Each task sums its own
table, tables are added up bucket by bucket, and the driver gets ``BUCKETS`` x ``DIMS`` numbers, whatever the
size of the corpus. Vectors are scaled to length one.

*Pooling.* A document is the mean of its tokens' vectors, the share of each mark and the
logarithm of its length.

*Network.* Two layers, trained by gradient descent with momentum on at most ``sample_rows`` labelled documents, those
with the smallest hash of their ids; a fifth of them is held back, and one temperature is chosen so that the
probabilities of those are calibrated.

Null and empty texts have no tokens; their features are zeros and they get a score like all others. Labels other than 0
and 1 and rows without an id are not learned from; repeated labels count once. If only one label, or none, is there to learn
from, all scores are its smoothed share. Other columns stay as they are; one called like the result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import need_columns, record_batch, row_column, slices, to_arrow

BUCKETS = 1 << 13
DIMS = 48
NONZERO = 4
REACH = 2
SAMPLE_ROWS = 8_000
MARKS = ("<caps>", "<again>", "<line>")
FEATURES = DIMS + len(MARKS) + 2

_TOKEN = regex.compile(r"\p{L}+|\p{N}+|\n|[^\s\p{L}\p{N}]+")

CONTEXTS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("vector", T.ArrayType(T.LongType()))]
)
POOLED = T.StructType([T.StructField("features", T.ArrayType(T.FloatType()))])
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def bucket(token: str) -> int:
    """The bucket of a token; the first buckets are those of the marks."""
    return len(MARKS) + zlib.crc32(token.encode()) % (BUCKETS - len(MARKS))


class Tokens:
    """Buckets of texts' tokens, with those of known tokens kept between texts."""

    def __init__(self, keep: int = 300_000) -> None:
        self.keep, self.known = keep, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        out, last, known = [], None, self.known
        if len(known) > self.keep:
            known.clear()
        for token in _TOKEN.findall((text or b"").decode("utf-8", "replace")):
            found = known.get(token)
            if found is None:
                found = known[token] = _buckets_of(token)
            if token == last:
                out.append(1)
            out += found
            last = token
        return np.array(out, np.int64)


def _buckets_of(token: str) -> tuple[int, ...]:
    if token == "\n":
        return (2,)
    if len(token) > 1 and token.isupper():
        return bucket(token.lower()), 0
    return (bucket(token.lower()),)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the dimensions of its index vector that are not zero, and their signs.

    One more bucket, which stands between texts, has no vector.
    """
    rng = np.random.default_rng(20_001)
    dims = rng.integers(0, DIMS, (BUCKETS + 1, NONZERO))
    signs = rng.choice(np.array([-1, 1]), (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return dims, signs


def add_contexts(tokens: np.ndarray, total: np.ndarray, dims: np.ndarray, signs: np.ndarray) -> None:
    """Add the neighbours' index vectors of each token to its bucket's row of ``total``."""
    flat = total.reshape(-1)
    for distance in range(1, REACH + 1):
        for start in range(0, len(tokens) - distance, 200_000):
            a = tokens[start : min(start + 200_000, len(tokens) - distance)]
            b = tokens[start + distance : start + distance + len(a)]
            for center, near in ((a, b), (b, a)):
                places = (center * DIMS)[:, None] + dims[near]
                flat += np.bincount(places.ravel(), signs[near].ravel(), len(flat))


def train_vectors(docs: DataFrame, text_col: str, block_tokens: int = 200_000) -> np.ndarray:
    """Context vectors of all buckets over all texts, scaled to length one."""
    need_columns(docs, text_col)
    schema = to_arrow(CONTEXTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = index_vectors()
        total, tokenize = np.zeros((BUCKETS + 1, DIMS)), Tokens()
        block, size = [], 0
        gap = np.full(REACH, BUCKETS)
        for (texts,) in slices(batches):
            for text in texts:
                tokens = tokenize(text)
                block.extend((tokens, gap))
                size += len(tokens)
                if size > block_tokens:
                    add_contexts(np.concatenate(block), total, dims, signs)
                    block, size = [], 0
        if block:
            add_contexts(np.concatenate(block), total, dims, signs)
        used = np.flatnonzero(total[:BUCKETS].any(axis=1))
        for start in range(0, len(used), 1000):
            part = used[start : start + 1000]
            yield record_batch([part.tolist(), total[part].astype(np.int64).tolist()], schema)

    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    sums = [F.sum(F.col("vector")[i]).alias(f"d{i}") for i in range(DIMS)]
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    for row in texts.mapInArrow(count, CONTEXTS).groupBy("bucket").agg(*sums).collect():
        vectors[row[0]] = row[1:]
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(lengths, 1e-9)


def pool(tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The features of a document."""
    out = np.zeros(FEATURES, np.float32)
    n = len(tokens)
    if n:
        for start in range(0, n, 100_000):
            out[:DIMS] += vectors[tokens[start : start + 100_000]].sum(axis=0)
        out[:DIMS] /= n
        out[DIMS : DIMS + len(MARKS)] = np.bincount(tokens[tokens < len(MARKS)], minlength=len(MARKS)) / n
        out[-2] = len(np.unique(tokens)) / n
    out[-1] = np.log1p(n)
    return out


@dataclass(frozen=True)
class Network:
    """Scaling, two layers and a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.05) -> Network:
    """Train on four fifths of the rows and calibrate on the rest."""
    held = np.arange(len(y)) % 5 == 4
    share = (y.sum() + 1) / (len(y) + 2)
    none = np.zeros(FEATURES)
    if len(y) < 10 or len(np.unique(y[~held])) < 2:
        return Network(none, none + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    rng = np.random.default_rng(7)
    mean, spread = x[~held].mean(axis=0), np.maximum(x[~held].std(axis=0), 1e-4)
    xs, ys = (x[~held] - mean) / spread, y[~held]
    parts = [rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    speed = [np.zeros_like(p) for p in parts]
    for epoch in range(epochs):
        order = rng.permutation(len(ys))
        step = rate * (1 - epoch / epochs)
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            h = np.tanh(xs[rows] @ parts[0] + parts[1])
            error = (_sigmoid(h @ parts[2] + parts[3]) - ys[rows]) / len(rows)
            back = np.outer(error, parts[2]) * (1 - h * h)
            slopes = [xs[rows].T @ back + 1e-4 * parts[0], back.sum(axis=0), h.T @ error + 1e-4 * parts[2], np.array([error.sum()])]
            for p, v, slope in zip(parts, speed, slopes, strict=True):
                v *= 0.9
                v -= step * slope
                p += v
    plain = Network(mean, spread, parts[0], parts[1], parts[2], float(parts[3][0]), 1.0)
    z, target = plain.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        p = np.clip(_sigmoid(z / temperature), 1e-6, 1 - 1e-6)
        return float(-(target * np.log(p) + (1 - target) * np.log(1 - p)).mean())

    best = min(np.geomspace(0.25, 8, 41), key=loss)
    return Network(mean, spread, parts[0], parts[1], parts[2], float(parts[3][0]), float(best))


def train(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str, text_col: str, rows: Column, sample_rows: int = SAMPLE_ROWS
) -> Network:
    """Fit on labelled documents for which ``rows``, a condition on the id, holds.

    ``labels`` has the id and ``label``, 0 or 1.
    """
    need_columns(labels, id_col, "label")
    chosen = (
        labels.where(rows & F.col("label").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def make() -> Callable[[bytes | None], tuple]:
        tokenize = Tokens()
        return lambda text: (pool(tokenize(text), sent.value).tolist(),)

    labelled = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    pooled = labelled.select("id", "label", row_column(make, POOLED)("text").alias("p")).select("id", "label", "p.features")
    found = sorted(pooled.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    x = np.array([r["features"] for r in found], np.float64).reshape(-1, FEATURES)
    return fit(x, np.array([r["label"] for r in found], np.float64))


def score_documents(
    docs: DataFrame, vectors: np.ndarray, network: Network, text_col: str = "text", into: str = "quality"
) -> DataFrame:
    """``docs`` with a struct column ``into`` that holds the calibrated ``score``."""
    need_columns(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def make() -> Callable[[bytes | None], tuple]:
        table, net = sent.value
        tokenize = Tokens()
        return lambda text: (float(net.score(pool(tokenize(text), table)[None, :])[0]),)

    return docs.withColumn(into, row_column(make, SCORE)(F.col(f"`{text_col}`").cast("binary")))
