"""Operators that judge or cut one text at a time, against plain models of their rules."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tableflow.llm.common import free_name, window_hashes, without_ids, word_hashes
from tableflow.llm.decontaminate import decontaminate
from tableflow.llm.line_rules import apply_line_rules, count_repeat_words, failed_rule
from tableflow.llm.substring import leftmost_smallest, remove_repeats

PROSE = " ".join(f"word{i}" for i in range(60)) + "."
SCHEMA = "doc_id long, text string, lang string, n_words long, `odd name` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], SCHEMA)


def test_hashes_do_not_depend_on_place_or_block():
    words = [f"w{i % 50}".encode() for i in range(400)]
    whole = word_hashes(b" ".join(words))
    assert whole[0] == whole[50] == word_hashes(b"\n\tw0 ")[0]
    assert len(set(whole.tolist())) == 50
    windows = window_hashes(whole, 7)
    assert windows[3] == windows[53] == window_hashes(whole[3:10], 7)[0]
    assert len(window_hashes(whole[:3], 7)) == 0


def test_long_text_is_hashed_in_blocks():
    text = b"alpha beta\n" * 200_000
    hashes = word_hashes(text)
    assert len(hashes) == 400_000 and len(set(hashes.tolist())) == 2


def test_leftmost_smallest():
    import numpy as np

    values = np.array([5, 3, 3, 9, 1, 1, 7, 2, 2, 2, 8])
    for size in range(1, 8):
        got = leftmost_smallest(values, size).tolist()
        assert got == [i + int(np.argmin(values[i : i + size])) for i in range(len(values) - size + 1)]


# Line rules


def brute_repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            hit.update(range(i, i + 3))
    return len(hit)


@pytest.mark.parametrize("text", ["", "a", "a a a", "a a a a", "a b c a b c", "x a b c y a b c z", "a b a b a b q"])
def test_repeat_words(text):
    words = text.encode().split()
    assert count_repeat_words(words) == brute_repeat_words(words)


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        (b"These are some plain words, nothing else.", None),
        (b"one%%% two*** three###", "symbols"),
        (b"home / news / sport / more", "navigation"),
        (b"THIS IS ALL SHOUTED TEXT HERE", "shouting"),
        (b"a!! b!! c!! d", "shouting"),
        (b"go go go go", "stutter"),
        (b"Copyright 2020 Someone", "boilerplate"),
        (b" ".join(b"word" + str(i).encode() for i in range(30)), "unpunctuated"),
    ],
)
def test_failed_rule(line, rule):
    assert failed_rule(line) == rule


def test_line_rules(spark):
    rows = [
        (1, PROSE),
        (2, None),
        (3, ""),
        (4, " \n\t\n"),
        (5, PROSE + "\nCopyright 2020 Someone\n" + PROSE),
        (6, "\n".join(["Copyright 2020 Someone " + " ".join(f"v{i}{j}" for i in range(9)) for j in range(9)])),
        (None, "é %x"),
        (1, PROSE),
    ]
    result = apply_line_rules(table(spark, rows), with_text=True)
    assert result.columns == ["doc_id", "text", "lang", "n_words", "odd name", "lines"]
    got = [(r["doc_id"], r["lines"]) for r in result.collect()]
    assert len(got) == len(rows)
    by_id = {k: v for k, v in got}
    assert by_id[1]["kept"] and by_id[1]["text_left"] == PROSE
    for empty in (2, 3, 4):
        assert not by_id[empty]["kept"] and by_id[empty]["n_words"] == 0 and by_id[empty]["base_failed"]
    assert by_id[5]["n_dup_lines"] == 1 and by_id[5]["n_words_left"] == 60 and by_id[5]["base_failed"]
    assert not by_id[6]["base_failed"] and not by_id[6]["kept"] and by_id[6]["n_words_left"] == 0
    assert (by_id[None]["word_chars"], by_id[None]["n_symbols"]) == (3, 1)
    assert apply_line_rules(table(spark, [])).count() == 0


# Decontamination


def brute_hits(docs, items, size):
    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit.update(range(i, i + n))
                        if item_id is not None:
                            found.add(item_id)
        ids = ",".join(sorted(map(str, found)))
        digest = hashlib.sha256(ids.encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate(spark, block_bytes):
    items = [
        (1, "Alpha beta GAMMA, delta; epsilon zeta"),
        (2, "beta gamma delta epsilon"),
        (30, "Ünder"),
        (4, None),
        (5, ""),
        (2, "beta gamma delta epsilon"),
        (None, "kappa lambda mu nu"),
    ]
    docs = [
        (1, "x alpha. beta (gamma) delta epsilon y z" + " pad" * 50),
        (2, "ünder ÜNDER under"),
        (3, None),
        (4, ""),
        (None, "kappa lambda mu nu"),
        (6, "alpha beta gamma x delta epsilon zeta"),
        (6, "delta epsilon zeta alpha beta gamma delta"),
        (1, "x alpha. beta (gamma) delta epsilon y z" + " pad" * 50),
    ]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    result = decontaminate(table(spark, docs), benchmark, size=4, block_bytes=block_bytes)
    assert "odd name" in result.columns
    got = [
        (r["doc_id"], *(r["tests"][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))
        for r in result.collect()
    ]
    assert sorted(got, key=str) == brute_hits(docs, items, 4)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["tests"]["contaminated"] for r in decontaminate(table(spark, docs), none).collect())
    assert decontaminate(table(spark, []), benchmark).count() == 0


# Repeated windows


def brute_cut(docs, size):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    counts = {}
    for _, words in split:
        for j in range(len(words) - size + 1):
            key = tuple(words[j : j + size])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for i, words in split:
        gone = set()
        for j in range(len(words) - size + 1):
            if counts[tuple(words[j : j + size])] > 1:
                gone.update(range(j, j + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_bytes", [1, 200, 1 << 20])
def test_remove_repeats(spark, group_bytes):
    import random

    rng = random.Random(3)
    shared = [" ".join(f"s{k}x{i}" for i in range(rng.randint(5, 14))) for k in range(6)]
    docs = [(1, None), (2, ""), (3, " \n "), (None, shared[0]), (None, "q " + shared[0])]
    docs += [(4, "to " * 30), (5, "to to to"), (5, "a b c d e f g"), (6, "a b c d e f g"), (6, "a b c d e f g")]
    for i in range(10, 40):
        parts = [" ".join(f"u{i}x{j}x{n}" for n in range(rng.randint(0, 6))) for j in range(4)]
        text = " ".join(p + "\n" + rng.choice(shared) for p in parts)
        docs.append((i, text if rng.random() < 0.7 else text.replace("x3", "y")))
    result = remove_repeats(table(spark, docs), window=7, anchor=3, group_bytes=group_bytes, with_text=True)
    rows = result.collect()
    got = [(r["doc_id"], r["cut"]["n_words"], r["cut"]["n_removed"], r["cut"]["kept_sha256"]) for r in rows]
    assert sorted(got, key=str) == brute_cut(docs, 7)
    for r in rows:
        left = r["cut"]["text_left"]
        assert hashlib.sha256(b" ".join(left.encode().split())).hexdigest() == r["cut"]["kept_sha256"]
        if not r["cut"]["n_removed"]:
            assert left == (r["text"] or "")
    assert remove_repeats(table(spark, [])).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"t{i}" for i in range(300_000))
    row = remove_repeats(table(spark, [(1, text), (2, text[-4000:])])).orderBy("doc_id").collect()
    assert row[0]["cut"]["n_removed"] >= row[1]["cut"]["n_words"] - 1 > 400
    lines = apply_line_rules(table(spark, [(1, text + ".")])).collect()[0]["lines"]
    assert lines["n_words"] == 300_000 and lines["kept"]


def test_helpers(spark):
    docs = table(spark, [(1, "a"), (2, "b"), (None, "c")])
    assert free_name(docs, "N_Words") == "_N_Words"
    ids = spark.createDataFrame([(1,)], "id long")
    for limit in (0, 10):
        left = [r["doc_id"] for r in without_ids(docs, "doc_id", ids, limit).collect()]
        assert sorted(left, key=str) == [2, None]
    assert docs.where(F.col("odd name") == "x").count() == 3
