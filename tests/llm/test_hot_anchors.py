"""Buckets of the de Bruijn edges stay bounded, and splitting them changes no result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableflow.llm import substring
from tableflow.llm.common import hash_texts
from tableflow.llm.substring import _group_rows, both_hashes, cut_into_pieces, remove_repeats, sampled_edges

SCHEMA = "doc_id long, text string"


def hot_phrase(words=8):
    """The phrase with the smallest hash of many: the anchor of nearly all windows around it."""
    tried = [" ".join(f"p{k}x{i}" for i in range(words)) for k in range(3000)]
    hashes = [int(both_hashes(hash_texts([p.encode()])[0], words)[0]) for p in tried]
    return tried[int(np.argmin(hashes))]


def documents(n, rng, phrase):
    """Texts that share the phrase and, every tenth, a passage."""
    passage = " ".join(f"same{i}" for i in range(60))
    rows = []
    for doc in range(n):
        words = [f"{rng.randrange(10**9)}" for _ in range(120)]
        words[60:60] = phrase.split()
        rows.append((doc, " ".join(words) + (f" {passage}" if doc % 10 == 0 else "")))
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents(2000, random.Random(3), hot_phrase())


def test_a_phrase_of_all_documents_is_split(rows):
    group = [(doc, text.encode(), 0) for doc, text in rows]
    hashes, counts = hash_texts([text for _, text, _ in group])
    _, _, at, _ = cut_into_pieces(hashes, counts, 35, 8)
    grams = both_hashes(hashes, 8)
    anchors, n = np.unique(grams[at], return_counts=True)
    hot = anchors[n > 5000]
    assert len(hot) == 1 and n.max() > 50_000

    def fullest(hot):
        sizes = {}
        for bucket, blob, *_ in _group_rows(group, 35, 8, 64, hot):
            if blob is not None:
                head = 8 + int.from_bytes(blob[:8], "little") * substring._HEAD.itemsize
                sizes[bucket] = sizes.get(bucket, 0) + (len(blob) - head) // 8
        return max(sizes.values()), sum(sizes.values())

    plain, total = fullest(np.empty(0, np.uint64))
    split, same_total = fullest(hot)
    assert total == same_total and plain > 50_000 and split < 2 * total / 64


def test_the_sample_finds_it(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(substring, "SAMPLE_BYTES", 1 << 30)  # all of this small table
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "docs"))  # the size of files is known
    stored = spark.read.parquet(str(tmp_path / "docs"))
    docs = stored.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("mark"))
    edges, hot = sampled_edges(docs, 35, 8, 1 << 20, 5000)
    assert len(hot) == 1 and 150_000 < edges < 250_000
    assert sampled_edges(docs.limit(0), 35, 8, 1 << 20, 5000)[0] == 0


def test_results_do_not_depend_on_the_split(spark, rows, monkeypatch):
    docs = spark.createDataFrame([*rows, (7, None), (None, "a b"), rows[5]], SCHEMA).repartition(4)

    def found(**more):
        got = remove_repeats(docs, **more).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect()
        return sorted(map(tuple, got), key=repr)

    plain = found()
    assert found(bucket_edges=3000) == plain == found(bucket_edges=20, group_bytes=1 << 14)
    monkeypatch.setattr(substring, "SAMPLE_BYTES", 1 << 12)
    assert found(bucket_edges=3000) == plain
    removed = {doc: n for doc, _, n, _ in plain if doc is not None and doc not in (5, 7)}
    assert all((n >= 60) == (doc % 10 == 0) and (doc % 10 == 0 or n == 0) for doc, n in removed.items())
