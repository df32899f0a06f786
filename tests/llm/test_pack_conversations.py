"""Conversations packed under three limits at once, against the tokenizer and the limits themselves."""

import os

import pytest

from tableflow.llm.packing import Limits, _Pool, pack_conversations
from tableflow.llm.queries import tokenizer_file
from tableflow.llm.tokens import WordTokenizer

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, length string, loss int"


def lengths_of(rows):
    tokenizer = WordTokenizer.shared(tokenizer_file())
    encoded = tokenizer.encode([(r[3] or "").encode() for r in rows])
    return [len(ids) // 4 + 1 for ids in encoded]


def checked(rows, segments, limits):
    """Segments cover each conversation's tokens once and in order, and sequences keep all limits without gaps."""
    sizes = {}
    for row, n in zip(rows, lengths_of(rows), strict=True):
        tokens, loss = sizes.get(row[0], (0, 0))
        sizes[row[0]] = tokens + n, loss + n * (row[2] == "assistant")
    found, bins = {}, {}
    for s in segments:
        tokens, loss = found.get(s["conv_id"], (0, 0))
        found[s["conv_id"]] = tokens + s["length"], loss + s["loss"]
        bins.setdefault(s["sequence_id"], []).append(s)
    assert found == sizes
    for parts in bins.values():
        parts.sort(key=lambda s: s["offset"])
        assert [s["offset"] for s in parts] == [sum(p["length"] for p in parts[:i]) for i in range(len(parts))]
        assert sum(s["length"] for s in parts) <= limits.tokens and len(parts) <= limits.segments
        assert sum(s["loss"] for s in parts) <= limits.loss
    return bins


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("limits", [Limits(2048, 64, 2048), Limits(2048, 3, 2048), Limits(2048, 64, 700), Limits(300, 2, 120)])
def test_given_conversations(spark, limits):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    bins = checked(rows, pack_conversations(table, tokenizer_file(), limits).collect(), limits)
    loss = max(sum(s["loss"] for s in parts) for parts in bins.values())
    assert loss > 0.8 * limits.loss or limits.loss == 2048
    assert limits.segments > 3 or max(len(parts) for parts in bins.values()) == limits.segments


def test_edge_rows_and_long_turns(spark):
    rows = [
        (1, None, "assistant", "word " * 900), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 0, "user", "lost"),
        (2, 0, "user", "x " * 5_000), (3, 0, "assistant", "a"), (-1, 5, "assistant", "b " * 70),
    ]
    frame = spark.createDataFrame([(*r, "odd", 1) for r in rows], SCHEMA)
    limits = Limits(256, 4, 100)
    segments = pack_conversations(frame, tokenizer_file(), limits, group_tokens=3_000).collect()
    checked(rows, segments, limits)
    assert max(s["loss"] for s in segments) <= 100 and any(s["start"] for s in segments)
    assert pack_conversations(frame.limit(0), tokenizer_file(), limits).count() == 0
    with pytest.raises(ValueError):
        pack_conversations(frame, tokenizer_file(), limits, turn_col="step")


def test_the_product_is_over_all_three_demands():
    pool = _Pool(Limits(100, 10, 50))
    pool.add(0, 0, 40, 0)
    pool.add(1, 0, 30, 25)
    kind, cut = pool.best(100, 10, 50)
    assert pool.keys[kind] == (30, 25) and not cut
    kind, _ = pool.best(100, 10, 5)
    assert pool.keys[kind] == (40, 0)
