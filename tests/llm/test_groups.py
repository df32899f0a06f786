"""Near-duplicate groups, components, packing, packages and urls, against brute force."""

import random
import struct
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

import corpus_pipeline
from tableflow.llm.components import connected_components
from tableflow.llm.near_dedup import bands, near_duplicates, shingles, similar
from tableflow.llm.packing import Limits, pack, pack_documents, split_tail
from tableflow.llm.queries import QUERIES, tokenizer_file
from tableflow.llm.tokens import WordTokenizer
from tableflow.llm.url_filter import Rule, TreeLimits, filter_urls
from tableflow.llm.warc_zip import DATA, INDEX, read_directory, read_packages, write_packages

SF_DIR = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (None, None), (7, 7), (900, 900)] + links[:20]
    union = Union()
    for a, b in links:
        if a is not None and b is not None and a != b:
            union.join(a, b)
    got, _ = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, union.find(x)) for x in union.parent)
    assert connected_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def brute_groups(docs, size, percent):
    sets = {i: shingles((t or "").encode(), size) for i, t in docs}
    union = Union()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        union.find(a)
        for b in ids[:k]:
            if similar(sets[a], sets[b], percent):
                union.join(a, b)
    return sorted((i, len(sets[i]), union.find(i), union.find(i) == i) for i in ids)


def near_copies(rng, n_bases, n_copies):
    docs, i = [], 0
    for b in range(n_bases):
        words = [f"b{b}w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(n_copies):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            docs.append((i, " ".join(copy)))
            i += 1
            if rng.random() < 0.3:
                words = copy  # chains: what is near a copy need not be near the first
    rng.shuffle(docs)
    return [(k, t) for k, (_, t) in enumerate(docs)]


@pytest.mark.parametrize("broadcast_ids", [0, 10**6])
def test_near_duplicates(spark, broadcast_ids):
    docs = near_copies(random.Random(5), 12, 14)
    docs += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (505, "two one"), (506, "")]
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n long")
    got = near_duplicates(frame, broadcast_ids=broadcast_ids)
    assert got.columns == ["id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute_groups(docs, 3, 85)


def test_near_duplicates_far_from_the_hub(spark):
    """Copies that are near each other and not the hub of their buckets, in chains and pairs."""
    rng, docs = random.Random(11), []
    base = [f"w{k}" for k in range(150)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 8, 9, 10])):
            copy[rng.randrange(150)] = f"z{rng.randrange(40)}"
        docs.append(" ".join(copy))
        for _ in range(rng.choice([0, 0, 1, 2])):
            copy = list(copy)
            copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute_groups(rows, 3, 85)
    assert len({r[2] for r in expected}) > 5
    assert sorted(map(tuple, got.collect())) == expected


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(frame).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (None, 2, None, True)]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_near_dedup_stage_keeps_one_of_rows_without_own_ids(spark):
    """Repeated ids and missing ids do not save copies, exact or near, and one of each group is left."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    near = other.replace("v59", "changed")
    rows = [(7, long), (7, long), (7, other), (9, long.upper()), (None, long), (3, "short one"), (3, "short one")]
    rows += [(None, "no id"), (None, "NO  id"), (None, near), (4, None), (4, None), (5, ""), (None, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    left = corpus_pipeline.near_dedup(spark, frame, "")
    assert left.columns == frame.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in left.collect()), key=str)
    expected = [(7, long), (7, other), (3, "short one"), (None, "no id"), (4, ""), (5, ""), (None, "")]
    assert got == sorted(((i, t.split()) for i, t in expected), key=str)
    schema = "doc_id long, lang string, source string, text string, n_chars long"
    copies = spark.createDataFrame([(i, "en", "x", long, len(long)) for i in (7, 7, None, None)], schema)
    cut = corpus_pipeline.substring_dedup(spark, corpus_pipeline.near_dedup(spark, copies, ""), "")
    assert [tuple(r) for r in cut.select("doc_id", "text").collect()] == [(7, long)]


def test_near_dedup_stage_equals_brute_force(spark):
    """Five words and 0.8: blocks that were added make near copies, scattered edits do not."""
    words = [f"w{k}" for k in range(200)]
    scattered = [f"z{k}" if k % 40 == 20 else w for k, w in enumerate(words)]
    docs = near_copies(random.Random(17), 12, 10)
    docs += [(900, " ".join(words)), (901, " ".join([*words, *(f"new{k}" for k in range(45))])), (902, " ".join(scattered))]
    docs += [(903, " ".join(words[:3])), (904, " ".join(words[:3])), (905, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert left == [i for i, _, _, kept in brute_groups(docs, 5, 80) if kept]
    assert left != [i for i, _, _, kept in brute_groups(docs, 3, 85) if kept] and 901 not in left


def test_bands_find_pairs_at_the_limit():
    rng = np.random.default_rng(0)
    for _ in range(300):
        common = rng.integers(1, 1 << 63, 85).astype(np.uint64)
        a = np.concatenate((common, rng.integers(1, 1 << 63, 7).astype(np.uint64)))
        b = np.concatenate((common, rng.integers(1, 1 << 63, 8).astype(np.uint64)))
        assert set(zip(range(32), bands(a))) & set(zip(range(32), bands(b)))


# Packing


def checked(pieces, sizes, limits):
    bins, items = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p.bin].append((p.offset, p.length))
        items[p.item].append((p.start, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments
        assert sum(length - 1 for _, length in parts) <= limits.loss
    for i, size in enumerate(sizes):
        at = 0
        for start, length in sorted(items[i]):
            assert start == at
            at += length
        assert at == size
    return [max(o + n for o, n in parts) for parts in bins.values()]


def test_pack_keeps_limits():
    rng = random.Random(2)
    for _ in range(200):
        limits = Limits(rng.choice([8, 16, 64]), rng.choice([1, 2, 5]), rng.choice([4, 8, 64]))
        sizes = [rng.randint(1, rng.choice([3, 40])) for _ in range(rng.randint(0, 40))]
        pieces = pack(sizes, limits)
        checked(pieces, sizes, limits)
        lengths = checked(split_tail(pieces, limits, 1), sizes, Limits(limits.tokens, 99, 99))
        assert all(n & (n - 1) == 0 or n == limits.tokens for n in lengths)


def test_pack_whole_examples():
    sizes, loss = [5, 5, 3, 3, 2, 8, 1], [4, 1, 2, 0, 1, 2, 0]
    limits = Limits(8, 3, 4)
    pieces = pack(sizes, limits, loss, cut=False)
    assert sorted(p.item for p in pieces) == list(range(7)) and all(p.start == 0 for p in pieces)
    by_bin = defaultdict(list)
    for p in pieces:
        by_bin[p.bin].append(p)
    for parts in by_bin.values():
        assert sum(p.length for p in parts) <= 8 and len(parts) <= 3 and sum(loss[p.item] for p in parts) <= 4
    with pytest.raises(ValueError, match="over a limit"):
        pack([9], limits, [1], cut=False)


def test_tokenizer_by_word():
    from tokenizers import Tokenizer

    path = tokenizer_file()
    whole, mine = Tokenizer.from_file(path), WordTokenizer(path, max_words=40)
    texts = ["", " \t", "The quick brown fox's it'LL 12ab%%% don't", "ÀÉ ΣΑΣ ǅ İstanbul e\u0301 x\x1cy \ufb01 ½ ª"]
    texts += ["<|endoftext|> a<|startoftext|>b", "a\xadb\u2028c µ ß ẞ \x00", " ".join(f"w{i}" for i in range(200))]
    for text, ids in zip(texts, mine.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "Beta,", "x9", "é"]) for _ in range(rng.choice([3, 40, 3000]))) for i in range(40)}
    texts |= {100: None, 101: ""}
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, start string")
    rows = pack_documents(frame, tokenizer_file(), with_ids=True).collect()
    expected = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = expected[r["id"]][r["start"] : r["start"] + r["length"]]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["ids_crc32"], bytes(r["token_ids"]), r["doc_tokens"]) == (zlib.crc32(raw), raw, len(expected[r["id"]]))
        docs[r["id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum(n for _, n in p) for i, p in docs.items()} == {i: len(x) for i, x in expected.items()}
    padding = 0
    for parts in sequences.values():
        total = sum(n for _, n in parts)
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding < 0.02 * sum(map(len, expected.values())) and max(map(len, sequences.values())) <= 64
    assert pack_documents(frame.limit(0), tokenizer_file()).count() == 0


# Packages


def test_packages(spark, tmp_path):
    big, other = "é<p>" * 400, "y" * 1000
    rows = [(1, "http://a.org/x y", big), (5, "http://a.org/é", big), (3, None, big), (2, "u", None), (4, "u", ""), (9, "u", "y" * 999)]
    rows += [(8, "u", "y" * 999), (6, "u", other), (None, "u", other), (7, "u", "z" * 5000), (None, "u", "q" * 2000), (None, "u", "q" * 2000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    manifest = write_packages(pages, str(tmp_path / "pk"), package_bytes=900).collect()
    assert len(manifest) > 2 and sum(r["records"] for r in manifest) == len(rows)
    frame = spark.createDataFrame(manifest, "path string, bytes long, records long")
    got = read_packages(frame, range_bytes=300, with_payload=True).collect()
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    large = len(big.encode())
    assert found == sorted(
        [(1, large, "revisit", 5), (5, large, "response", None), (3, large, "revisit", 5), (2, 0, "response", None)]
        + [(4, 0, "response", None), (9, 999, "response", None), (8, 999, "response", None), (6, 1000, "response", None)]
        + [(None, 1000, "revisit", 6), (7, 5000, "response", None)] + [(None, 2000, "response", None)] * 2,
        key=str,
    )
    assert {r["page_id"]: r["payload"] for r in got if r["page_id"] == 5}[5] == big.encode()
    with zipfile.ZipFile(manifest[0]["path"]) as package:
        assert package.testzip() is None and package.namelist() == [DATA, INDEX]
    assert write_packages(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_directory_formats(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("deflated", "a" * 500, compress_type=zipfile.ZIP_DEFLATED)
        with package.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as member:
            member.write(b"hello")
        package.writestr("plain", b"world")
        package.comment = b"PK\x05\x06 in a comment, at some length to mislead"
    with pa.fs.LocalFileSystem().open_input_file(str(path)) as file:
        members = read_directory(file)
        assert set(members) == {"wide", "plain"}
        assert file.read_at(members["wide"].size, members["wide"].start) == b"hello"
        assert file.read_at(members["plain"].size, members["plain"].start) == b"world"


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("first", b"0123456789abcdef")
        package.writestr("second", b"more than ten bytes")
    assert b"PK\x06\x06" in path.read_bytes()
    with pa.fs.LocalFileSystem().open_input_file(str(path)) as file:
        members = read_directory(file)
        assert file.read_at(members["second"].size, members["second"].start) == b"more than ten bytes"


def test_broken_packages_raise(spark, tmp_path):
    path = tmp_path / "broken.wacz"
    path.write_bytes(b"nothing of the kind" * 10)
    frame = spark.createDataFrame([(str(path),)], "path string")
    with pytest.raises(Exception, match="broken.wacz"):
        read_packages(frame).count()


# Urls


def test_url_rules(spark):
    rules = [Rule("org/", True), Rule("example.org/es/", False), Rule("example.org/en/1", False), Rule("com/fr/", True)]
    urls = [
        ("http://A.Example.ORG/en/1x?q=/es/", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        ("x://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://org?a", "org", "", None, "allow"),
        ("x://org/#a/b", "org", "/", "org/", "allow"),
        ("https://b.com/fr/1://c.org/", "b.com", "/fr/1://c.org/", "com/fr/", "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, good int")
    rows = filter_urls(pages, labels, rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [u[1:] for u in urls]
    assert filter_urls(pages.limit(0), labels, rules).count() == 0


def test_url_templates(spark):
    pages, labels, i = [], [], 0
    for section, good in (("shop", 0.02), ("news", 0.95), ("blog", 0.93)):
        for k in range(80):
            pages.append((i, f"http://h.net/{section}/item-{k}/{k * 7}"))
            if k % 2:
                labels.append((i, int(k / 80 < good)))
            i += 1
    labels += [(0, None), (1, 5)]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    rows = {r["page_id"]: r for r in filter_urls(*frames, [], limits=TreeLimits(max_children=10)).collect()}
    assert {rows[k]["verdict"] for k in range(80)} == {"block"}
    assert {rows[k]["verdict"] for k in range(80, 240)} == {"allow"}
    assert rows[0]["template"] == "/shop/item-{n}/{n}" and rows[100]["template"] == rows[200]["template"]


def test_url_templates_of_deep_paths(spark):
    """Branches that differ in the tenth segment only are judged apart; one deep path does not add levels."""
    deep = "http://h.net/a/b/c/d/e/f/g/h/i"
    pages = [(k, f"{deep}/{'bad' if k < 60 else 'fine'}/part-{k}/{k}") for k in range(200)]
    labels = [(k, int(k >= 60)) for k in range(200)]
    lone = "/".join(f"s{chr(97 + k % 26)}" for k in range(400))
    pages += [(500, f"http://h.net/{lone}//x/"), (502, f"{deep}/"), (503, f"http://one.net/{lone}/")]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    rows = {r["page_id"]: r for r in filter_urls(*frames, []).collect()}
    assert len(rows) == len(pages)
    assert {rows[k]["verdict"] for k in range(60)} == {"block"} and {rows[k]["verdict"] for k in range(60, 200)} == {"allow"}
    assert rows[0]["template"] == "/a/b/c/d/e/f/g/h/i/bad/part-{n}/{n}" and rows[502]["template"] == "/a/b/c/d/e/f/g/h/i"
    assert rows[503]["template"] == f"/{lone}"


@pytest.mark.parametrize("key", ["op2_warc_zip", "op6_url_filter", "op8_packing"])
def test_queries_run(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0
