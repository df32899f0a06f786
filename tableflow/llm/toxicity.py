"""Toxicity scores from a lexicon that also catches misspelled terms, weighed by context.

*Lexicon.* From a bounded sample of labelled documents (``sample_rows`` of each label, those with the smallest
hash of their ids, near copies by one min-hash counted once), tokens and beginnings of tokens are taken up that occur in three
toxic documents at least, with a precision of at least ``precision``, and either in ``min_share`` of the toxic documents or
too often for chance: by the Chernoff bound, less than one of all tokens of the sample would get there by
chance. So the more documents hold a term, the surer it is taken, however many others there are. A beginning is taken
instead of whole words if no single word accounts for most of its documents.

*Automaton.* The lexicon is a trie. A Levenshtein automaton for every term, one edit (two swapped letters are one) for terms and
beginnings of four letters or more and none for shorter ones, is intersected with the trie: a state is the set of (node, edits)
that the characters read so far can have reached, and transitions are made when first needed. Whole words before beginnings,
and fewer edits before more. A word costs one step for
each character, and most words reach the empty state after two or three.

*Weights.* A term's weight is its smoothed precision among the labelled documents. That of a word near a term is the probability that it is
the term misspelled, see :func:`neighbour_weights`: from the documents that hold it, or, where none does, from the neighbours of the term that a
single document holds, as these come nearest to unseen ones. So a harmless word that is one edit away from a term counts for nothing once it
was seen in clean documents, and a term whose neighbourhood is full of such words catches no others: weights below ``least`` are dropped.

*Context.* A hit counts in full unless an open quotation mark stands within ``reach`` tokens before it and a closing one
within as many after: then it is taken for a quotation and counts ``quoted`` of its weight, except when unquoted hits
stand in the same window. Scores are one minus the product of what different hit words leave over; a repeated word
counts once, with its highest weight.

Null and empty texts have no hits and score ``floor``. Labels other than 0 and 1, and rows without an id, are not learned
from; repeated labels count once. Without toxic training rows the lexicon is empty and all scores are ``floor``. Repeated
rows get equal results. Other columns stay as they are; one called like the result is replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import need_columns, record_batch, row_column, slices, to_arrow, window_hashes, word_hashes
from tableflow.sources.scratch import drop_scratch, written

SAMPLE_ROWS = 6_000
LEAST_DOCUMENTS = 3
STEM_LETTERS = (4, 5, 6, 7)
FUZZY_LETTERS = 5
WIDE_LETTERS = 4
LONG_LETTERS = 7
UNSEEN = 0.4
UNSEEN_WORDS = 2
DRAWN = 10
STRAY = 0.1
LEAST_PART = 0.01

_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
OPENING, CLOSING = "\"“«„‘", "\"”»“’"

COUNTS = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("stem", T.BooleanType()),
        T.StructField("toxic", T.LongType()),
        T.StructField("clean", T.LongType()),
    ]
)
SCORE = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_hits", T.LongType()),
        T.StructField("n_quoted", T.LongType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
    ]
)
_SIGNED = T.StructType([T.StructField("sketch", T.LongType())])
_MATCH = T.StructType([T.StructField("term", T.StringType()), T.StructField("edits", T.IntegerType())])


def core(token: str) -> str:
    """A token in lower case without signs at its ends."""
    return _EDGE.sub("", token).lower()


@dataclass
class _Node:
    children: dict[str, int] = field(default_factory=dict)
    term: str | None = None
    stem: bool = False
    allowance: int = 0  # the most edits that a term below this node allows
    own: int = 0  # those that the term of this node allows


class FuzzyLexicon:
    """The trie of a lexicon and the lazily made product of it with the Levenshtein automata.

    Plain, one edit is allowed for words of ``FUZZY_LETTERS`` or more. ``wide`` also allows one for words and
    beginnings of ``WIDE_LETTERS`` or more, and counts a swap of two neighbouring letters as one.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str], max_states: int = 200_000, wide: bool = False) -> None:
        self.nodes = [_Node()]
        self.max_states = max_states
        self.wide = wide
        for text, stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            self._add(text, stem)
        self._reset()

    def _add(self, text: str, stem: bool) -> None:
        allowance = int(len(text) >= WIDE_LETTERS if self.wide else not stem and len(text) >= FUZZY_LETTERS)
        at = 0
        for char in text:
            self.nodes[at].allowance = max(self.nodes[at].allowance, allowance)
            if char not in self.nodes[at].children:
                self.nodes[at].children[char] = len(self.nodes)
                self.nodes.append(_Node())
            at = self.nodes[at].children[char]
        node = self.nodes[at]
        node.term, node.stem, node.allowance = text, node.stem or stem, max(node.allowance, allowance)
        node.own = max(node.own, allowance)

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.stems: list[tuple[str | None, str | None]] = []
        self.start = self._state(self._closed({0: 0}))

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.steps.append({})
            ends = [(self.nodes[n], e) for n, e in members if not isinstance(n, tuple) and self.nodes[n].stem]
            exact = min((n.term for n, e in ends if e == 0), default=None)
            self.stems.append((exact, min((n.term for n, e in ends if 0 < e <= n.own), default=None)))
        return self.states[members]

    def _closed(self, reached: dict) -> frozenset:
        """With the nodes that letters left out lead to; of each node the fewest edits."""
        todo = [(n, e) for n, e in reached.items() if not isinstance(n, tuple)]
        while todo:
            node, edits = todo.pop()
            for child in self.nodes[node].children.values():
                if edits + 1 <= self.nodes[child].allowance and edits + 1 < reached.get(child, 9):
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(reached.items())

    def _step(self, state: int, char: str) -> int:
        reached: dict = {}
        for node, edits in self.members[state]:
            if isinstance(node, tuple):  # the first of two swapped letters is still to come
                if char == node[1]:
                    reached[node[0]] = min(edits, reached.get(node[0], 9))
                continue
            here = self.nodes[node]
            if edits + 1 <= here.allowance:  # a letter too many
                reached[node] = min(edits + 1, reached.get(node, 9))
            for letter, child in here.children.items():
                cost = edits + (letter != char)
                if cost <= max(self.nodes[child].allowance, 0 if edits == 0 and letter == char else -1):
                    reached[child] = min(cost, reached.get(child, 9))
                if self.wide and letter != char:
                    after = self.nodes[child].children.get(char)
                    if after is not None and edits + 1 <= self.nodes[after].allowance:
                        reached[after, letter] = edits + 1
        return self._state(self._closed(reached))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is, begins with, or is a misspelling of, and the number of edits."""
        state, stem, near_stem = self.start, None, None
        if len(self.members) > self.max_states:
            self._reset()
            state = self.start
        for char in word:
            after = self.steps[state].get(char)
            if after is None:
                after = self.steps[state][char] = self._step(state, char)
            state = after
            if not self.members[state]:
                break
            exact, near = self.stems[state]
            stem, near_stem = exact or stem, near_stem or near
        found = [
            (edits, self.nodes[n].term)
            for n, edits in self.members[state]
            if not isinstance(n, tuple)
            and self.nodes[n].term is not None
            and (edits == 0 or not self.nodes[n].stem and edits <= self.nodes[n].own)
        ]
        best = min(found, default=None)
        if stem is not None and (best is None or best[0] > 0):
            return stem, 0
        if best is None:
            return (near_stem, 1) if near_stem else None
        return best[1], best[0]


@dataclass(frozen=True)
class ToxicityModel:
    """Terms and beginnings with their precisions, known misspellings' and those of others by term.

    ``other_short`` and ``other_long`` are for terms that ``others`` does not hold.
    """

    words: dict[str, float]
    stems: dict[str, float]
    variants: dict[str, float]
    other_short: float
    other_long: float
    others: dict[str, float] = field(default_factory=dict)

    def weight(self, token: str, term: str, edits: int) -> float:
        """Of a token that the automaton has matched."""
        if not edits:
            return self.words.get(term, self.stems.get(term, 0.0))
        if token in self.variants:
            return self.variants[token]
        return self.others.get(term, self.other_long if len(term) >= LONG_LETTERS else self.other_short)


def likely(n_toxic: int, n_clean: int, n_tokens: int, min_share: float, precision: float) -> Column:
    """Whether a token's counts, ``toxic`` and ``clean``, speak for a term. ``n_tokens``: how many are tried."""
    toxic, both = F.col("toxic"), F.col("toxic") + F.col("clean")
    base = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    share = toxic / both
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    surprise = both * (share * F.log(share / base) + other)
    sure = (share > base) & (surprise >= float(np.log(max(1, n_tokens))))
    return (toxic >= LEAST_DOCUMENTS) & (toxic >= precision * both) & ((toxic >= min_share * n_toxic) | sure)


def choose_terms(good: list[tuple[str, bool, int, int]]) -> tuple[dict, dict]:
    """Words and beginnings of the lexicon with their smoothed precisions, from the likely ones with their counts."""
    words = {t: (a, b) for t, stem, a, b in good if not stem}
    stems = {t: (a, b) for t, stem, a, b in good if stem}
    top: dict[str, int] = {}
    for word, (toxic, _) in words.items():
        for n in STEM_LETTERS:
            top[word[:n]] = max(top.get(word[:n], 0), toxic)
    longer: dict[str, list[str]] = {}
    for stem in stems:
        for n in STEM_LETTERS:
            if n <= len(stem):
                longer.setdefault(stem[:n], []).append(stem)
    chosen: dict[str, tuple[int, int]] = {}
    for stem in sorted(stems, key=lambda s: (len(s), s)):
        if _begins(stem, chosen) or 10 * top.get(stem, 0) > 7 * stems[stem][0]:
            continue
        best = max((s for s in longer[stem] if 50 * stems[s][0] >= 49 * stems[stem][0]), key=lambda s: (len(s), s))
        chosen[best] = stems[best]
    words = {w: c for w, c in words.items() if not _begins(w, chosen)}

    def smooth(found: dict) -> dict[str, float]:
        return {t: (toxic + 0.5) / (toxic + clean + 1) for t, (toxic, clean) in found.items()}

    return smooth(words), smooth(chosen)


def _begins(word: str, stems: dict) -> bool:
    return any(word[:n] in stems for n in STEM_LETTERS)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    rows: Column,
    sample_rows: int = SAMPLE_ROWS,
    min_share: float = 0.01,
    precision: float = 0.9,
) -> ToxicityModel:
    """Learn from labelled documents for which ``rows``, a condition on the id, holds.

    ``labels`` has the id and ``label``, 1 for toxic and 0 for clean.
    """
    need_columns(docs, id_col, text_col)
    need_columns(labels, id_col, "label")
    spark = docs.sparkSession
    valid = labels.where(rows & F.col("label").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
    labelled = valid.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max("label").alias("label"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    chosen = labelled.where("label = 1").orderBy(*by_hash).limit(sample_rows)
    chosen = chosen.unionByName(labelled.where("label = 0").orderBy(*by_hash).limit(sample_rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    sketched = texts.join(F.broadcast(chosen), "id").withColumn("s", row_column(_sketch, _SIGNED)("text"))
    sample, sample_path = written(
        sketched.select("label", "text", "s.sketch").groupBy("label", "sketch").agg(F.min("text").alias("text")), "sample"
    )
    counted = sample.select("label", "text").mapInArrow(_count_tokens, COUNTS)
    counts, counts_path = written(
        counted.groupBy("token", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "counts"
    )
    of_label = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_tokens = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).count()
    good = counts.where(likely(of_label.get(1, 0), of_label.get(0, 0), n_tokens, min_share, precision))
    words, stems = choose_terms([tuple(r) for r in good.collect()])
    lexicon = FuzzyLexicon(words, stems, wide=True)

    def make() -> Callable[[str], tuple]:
        return lambda token: lexicon.match(token) or (None, None)

    matched = counts.where("NOT stem").select("token", "toxic", "clean", row_column(make, _MATCH)("token").alias("m"))
    near = matched.where("m.edits > 0").select("token", "toxic", "clean", "m.term").collect()
    share = (of_label.get(1, 0) + 1) / (sum(of_label.values()) + 2)
    variants, others = neighbour_weights([tuple(r) for r in near], [*words, *stems], share)
    drop_scratch(spark, sample_path, counts_path)
    return ToxicityModel(words, stems, variants, UNSEEN, UNSEEN, others)


def neighbour_weights(
    near: list[tuple[str, int, int, str]], terms: list[str], share: float
) -> tuple[dict[str, float], dict[str, float]]:
    """How likely known neighbours are misspelled terms, from (token, toxic, clean, term), and a neighbour of each term that was never seen.

    ``share`` is that of toxic documents. A word that is near a term by chance is met in toxic documents as often as any other; what neighbours met
    once exceed that rate by is the part of them that is misspelled. It is taken term by term, drawn to that of all terms with a weight of
    ``DRAWN`` words, and that to ``UNSEEN`` with one of ``UNSEEN_WORDS``. A known neighbour's own documents then decide by Bayes' rule, where a
    misspelled term's are toxic but for ``STRAY``.
    """
    once: dict[str, list[int]] = {term: [0, 0] for term in terms}
    for _, toxic, clean, term in near:
        if toxic + clean == 1:
            once[term][toxic] += 1
    start = share + UNSEEN * (1 - share)
    rate = (sum(x[1] for x in once.values()) + UNSEEN_WORDS * start) / (sum(map(sum, once.values())) + UNSEEN_WORDS)
    others = {}
    for term, (clean, toxic) in once.items():
        own = (toxic + DRAWN * rate) / (toxic + clean + DRAWN)
        others[term] = min(max((own - share) / (1 - share), 0.0), 1 - STRAY)
    variants = {}
    for token, toxic, clean, term in near:
        part = max(others[term], LEAST_PART)
        misspelled = math.log(part) + toxic * math.log(1 - STRAY) + clean * math.log(STRAY)
        chance = math.log(1 - part) + toxic * math.log(share) + clean * math.log(1 - share)
        variants[token] = 1 / (1 + math.exp(min(chance - misspelled, 700.0)))
    return variants, others


def _sketch() -> Callable[[bytes | None], tuple]:
    def row(text: bytes | None) -> tuple:
        words = word_hashes((text or b"").lower())
        found = window_hashes(words, min(3, len(words))) if len(words) else np.zeros(1, np.uint64)
        return (int(found.min().astype(np.int64)),)

    return row


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, bool], list[int]] = {}
    schema = to_arrow(COUNTS)

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        batch = record_batch(
            [[k[0] for k in keys], [k[1] for k in keys], [counts[k][1] for k in keys], [counts[k][0] for k in keys]], schema
        )
        counts.clear()
        return batch

    for labels, texts in slices(batches):
        for label, text in zip(labels, texts, strict=True):
            tokens = {core(t) for t in set((text or b"").decode("utf-8", "replace").split())} - {""}
            stems = {t[:n] for t in tokens for n in STEM_LETTERS if len(t) >= n}
            for key in [(t, False) for t in tokens] + [(s, True) for s in stems]:
                counts.setdefault(key, [0, 0])[label] += 1
        if len(counts) > 200_000:
            yield flush()
    yield flush()


def _scorer(
    sent, reach: int, quoted: float, floor: float, least: float, keep: int
) -> Callable[[], Callable[[bytes | None], tuple]]:
    def make() -> Callable[[bytes | None], tuple]:
        model: ToxicityModel = sent.value
        lexicon = FuzzyLexicon(model.words, model.stems, wide=True)
        known: dict[str, tuple[float, str] | None] = {}

        def weigh(token: str) -> tuple[float, str] | None:
            found = lexicon.match(core(token))
            weight = model.weight(core(token), *found) if found else 0.0
            return (weight, found[0]) if weight >= least else None

        def row(text: bytes | None) -> tuple:
            tokens = (text or b"").decode("utf-8", "replace").split()
            new = set(tokens).difference(known)
            if len(known) + len(new) > keep:
                known.clear()
                new = set(tokens)
            for token in new:
                known[token] = weigh(token)
            hits = [i for i, token in enumerate(tokens) if known[token] is not None]
            inside = [_is_quoted(tokens, i, reach) for i in hits]
            unquoted = [i for i, is_quoted in zip(hits, inside, strict=True) if not is_quoted]
            weights: dict[str, float] = {}
            terms = set()
            for i, is_quoted in zip(hits, inside, strict=True):
                weight, term = known[tokens[i]]
                near = bisect_left(unquoted, i - reach)
                open_hit = not is_quoted or (near < len(unquoted) and unquoted[near] <= i + reach)
                word = core(tokens[i])
                weights[word] = max(weights.get(word, 0.0), weight * (1 if open_hit else quoted))
                terms.add(term)
            left = (1 - floor) * float(np.prod([1 - w for w in weights.values()]))
            return min(1.0, max(0.0, 1 - left)), len(hits), sum(inside), sorted(terms)

        return row

    return make


def _is_quoted(tokens: list[str], at: int, reach: int) -> bool:
    """Whether an opening mark stands before the token, unclosed, and a closing one after, both near."""
    start = at
    while start >= max(0, at - reach):
        token = tokens[start]
        if token[0] in OPENING:
            break
        if start < at and token.rstrip(".,;:!?")[-1:] in CLOSING and token.rstrip(".,;:!?"):
            return False
        start -= 1
    else:
        return False
    return any((t.rstrip(".,;:!?") or " ")[-1] in CLOSING for t in tokens[at : at + reach + 1])


def score_documents(
    docs: DataFrame,
    model: ToxicityModel,
    text_col: str = "text",
    reach: int = 12,
    quoted: float = 0.25,
    floor: float = 0.01,
    least: float = 0.2,
    keep_tokens: int = 300_000,
    into: str = "toxicity",
) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``SCORE``."""
    need_columns(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = row_column(_scorer(sent, reach, quoted, floor, least, keep_tokens), SCORE)
    return docs.withColumn(into, column(F.col(f"`{text_col}`").cast("binary")))
