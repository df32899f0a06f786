"""The trie of conversation openings against a plain model, with small components, deep chains and hot openings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tableflow.llm.prefix_trie import Opening, add_up, conversation_trie
from tableflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, words string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "w") for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def originals(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def reopened(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def model(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved, out = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0), []
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, of in members.items():
        value = (len(of) - 1) * len(node[-1][1].split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += value
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(of), len(node), parent, len(of), children.get(node, 0), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def random_rows(rng, n, turns=4, words=3):
    return [
        (c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, words))))
        for c in range(n)
        for t in range(rng.randint(1, turns))
    ]


def brute_totals(parents, values):
    out = list(values)
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def test_add_up_on_random_trees():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 60)
        tree = [0] + [rng.randrange(max(0, i - rng.choice([1, 5, 60])), i) for i in range(1, n)]
        level = [0] * n
        for i in range(1, n):
            level[i] = level[tree[i]] + 1
        order = sorted(range(n), key=lambda i: level[i])
        place = {v: k for k, v in enumerate(order)}
        parents = [place[tree[v]] if v else -1 for v in order]
        values, own = [rng.randint(-5, 9) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)]
        sums = [0] * n
        add_up(parents, brute_totals(parents, own), [values], [sums])
        assert sums == brute_totals(parents, values)
    add_up([], [], [[]], [[]])


def test_long_chain_takes_few_rounds():
    n = 50_000
    sums = [0] * n
    add_up(list(range(-1, n - 1)), list(range(n, 0, -1)), [[1] * n], [sums])
    assert sums == list(range(n, 0, -1))


@pytest.mark.parametrize("component", [1, 7, 1 << 15])
def test_random_conversations(spark, component):
    rng = random.Random(component)
    rows = random_rows(rng, 80)
    rows += [(c, t, "user", "the same") for c in range(100, 130) for t in range(3)]  # a hot group of copies
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(60)] + [(501, t, "user", f"turn {t % 7}") for t in range(45)]
    trie, _ = conversation_trie(table(spark, rows), component=component)
    assert rows_of(trie) == model(originals(rows))


def test_conversations_over_many_parts(spark):
    rows = [(c, t, "user", "same words here") for c in (1, 2, 3) for t in range(400)] + [(4, 0, "user", "other")]
    many = table(spark, rows).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        trie, _ = conversation_trie(many, component=50)
        assert rows_of(trie) == model(originals(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "", ""), (2, 5, "user", ""), (2, 4, "user", " \n"),
        (None, 0, "user", "lost"), (-7, 1, "us", "era b"), (-8, 1, "user", "a b"), (-9, 1, "user", "a b"), (-9, 1, "bot", "x"),
        (3, 0, "user", "word " * 30_000),
    ]
    assert rows_of(conversation_trie(table(spark, rows))[0]) == model(originals(rows))


def test_empty_table_and_wrong_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    trie, _ = conversation_trie(empty)
    assert trie.count() == 0
    assert conversation_trie(table(spark, [(None, 0, "user", "a")]))[0].count() == 0
    with pytest.raises(ValueError):
        conversation_trie(empty, turn_col="step")
    with pytest.raises(ValueError):
        conversation_trie(empty, id_col="text")


def test_opening_from_an_absent_or_short_conversation(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "c"), (2, 1, "u", "d"), (2, 2, "u", "e"), (3, 0, "u", "f")]
    opening = Opening(base=F.when(F.col("conv") == 3, 99).otherwise(1), turns=F.lit(3))
    trie, _ = conversation_trie(table(spark, rows), opening=opening)
    convs = {1: [("u", "a"), ("u", "b")], 2: [("u", "a"), ("u", "b")], 3: []}
    assert rows_of(trie) == model(convs)


def test_query_equals_model(spark, tmp_path):
    rows = [r for r in random_rows(random.Random(6), 300, 6) if r[0] % 40 or r[0] % 3]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_conversation_trie"](spark, str(tmp_path))
    assert rows_of(got) == model(reopened(originals(rows)))
