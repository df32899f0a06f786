"""Runs: stretches of words that repeat themselves at a fixed distance.

A run is a stretch with smallest period q (words q apart are equal) that holds ``least`` words and ``repeats`` periods or more,
and that no neighbouring word extends with that period. All runs of a text are found, and exactly:

1. **Filter.** Every few words in a row (9 for the defaults) inside a run recur inside it, so words that lie in no repeated
   window of that size lie in no run. What is left falls into stretches, each of which holds its runs whole. Windows are told apart by
   hashes; a collision only keeps words that could have been left out.
2. **Grouping.** Phase one of Baier's suffix sorter: positions are grouped by a context, at first one word. From the
   highest group down, each position hands its context to the nearest position of a lower group before it, which moves into a group
   of its own right above its old one. The context that a position has when its group is taken is the longest
   Lyndon word that starts there. This is done under the order of the words and under its reverse.
3. **Roots.** By the runs theorem each run holds a Lyndon root of its period under one of the two orders, at every place
   where that root fits. The root is extended to both sides by the longest common extension, which comes from exact names of all blocks
   of 2, 4, 8 ... words, and what is long enough is a run.

Work is proportional to the words of the stretches, times a logarithm for the names. A text is in memory as a whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import mix, need_columns, row_column, runs as true_runs, window_hashes

LEAST, REPEATS = 24, 3

#: Times that the filter is applied to what it has left; more would be right too.
_FILTERS = 4

_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])

RUNS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("spans", T.ArrayType(_RUN)),
        T.StructField("strongest", _RUN),
        T.StructField("collapsed_sha256", T.StringType()),
        T.StructField("text_left", T.StringType()),
    ]
)


def lyndon_lengths(ranks: list[int], n_ranks: int) -> list[int]:
    """For each position the length of the longest Lyndon word that starts there; a proper prefix is the smaller word.

    ``ranks`` are numbers below ``n_ranks``. Positions not taken yet form a linked list, and a position's context always
    reaches up to the next of them.
    """
    n = len(ranks)
    group = [-1, *ranks]  # place 0 stands before the text and is never taken
    before, after = list(range(-1, n + 1)), list(range(1, n + 3))
    size = [1] * (n + 1)
    members: list[list[int]] = [[] for _ in range(n_ranks)]
    for place in range(n, 0, -1):  # members stand in descending order, always
        members[group[place]].append(place)
    count = [len(x) for x in members]
    lower, higher = list(range(-1, n_ranks - 1)), [*range(1, n_ranks), -1] if n_ranks else []
    top = n_ranks - 1
    while top >= 0:
        taken = top
        top = lower[taken]
        if top >= 0:
            higher[top] = -1
        if not count[taken]:
            continue
        heirs, length = [], 0
        for place in members[taken]:
            if group[place] != taken:  # it has moved on
                continue
            length = size[place]
            left, right = before[place], after[place]
            after[left], before[right] = right, left
            if group[left] != taken and left:
                heirs.append(left)
        members[taken] = []
        if len(heirs) == 1 and count[group[heirs[0]]] == 1:
            size[heirs[0]] = after[heirs[0]] - heirs[0]
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for place in heirs:
            times = (after[place] - place - size[place]) // length
            size[place] = after[place] - place
            moves.setdefault((times, group[place]), []).append(place)
        for (_, old), places in sorted(moves.items(), key=lambda x: -x[0][0]):
            if len(places) == count[old]:
                continue  # all that are left of a group: it stands where the new one would
            new = len(members)
            members.append(places)
            count.append(len(places))
            count[old] -= len(places)
            for place in places:
                group[place] = new
            above = higher[old]
            lower.append(old)
            higher.append(above)
            higher[old] = new
            if above >= 0:
                lower[above] = new
            else:
                top = new
    return size[1:]


def _window(least: int, repeats: int) -> int:
    """The longest window that recurs inside every run that holds it."""
    return max(1, min(max(least, repeats * q) - 2 * q + 1 for q in range(1, least // repeats + 2)))


def _stretches(ids: np.ndarray, least: int, window: int, filters: int = _FILTERS) -> Iterator[tuple[int, int]]:
    """(start, end) of what the filter leaves; every run lies within one of them."""
    if len(ids) < least:
        return
    grams = window_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), window)
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    repeated = counts[which] > 1
    for start, end in true_runs(repeated):
        end += window - 1
        if end - start < least:
            continue
        if filters <= 1 or end - start == len(ids):
            yield start, end
            continue
        for a, b in _stretches(ids[start:end], least, window, filters - 1):
            yield start + a, start + b


class _Blocks:
    """Exact names of all blocks of 1, 2, 4 ... words of a stretch, for common extensions of many pairs of places at once."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.n, self.names = len(ranks), [ranks]
        while 2 << (len(self.names) - 1) <= self.n:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1])

    def same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether blocks of 2**level words at i and at j, where i < j, are equal; False where they do not fit."""
        names = self.names[level]
        fits = (i >= 0) & (j < len(names))
        out = np.zeros(len(i), bool)
        out[fits] = names[i[fits]] == names[j[fits]]
        return out

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            n += self.same(level, i + n, j + n).astype(np.int64) << level
        return n

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            step = 1 << level
            n += self.same(level, i - n - step, j - n - step).astype(np.int64) << level
        return n


def _runs_of_stretch(ids: np.ndarray, least: int, repeats: int, window: int) -> Iterator[tuple[int, int, int]]:
    values, ranks = np.unique(ids, return_inverse=True)
    blocks = _Blocks(ranks)
    level = min(window.bit_length(), len(blocks.names)) - 1
    places = np.arange(len(ranks), dtype=np.int64)
    found = set()
    for order in (ranks, len(values) - 1 - ranks):
        periods = np.array(lyndon_lengths(order.tolist(), len(values)), np.int64)
        # the first root of a run is followed by itself, so by at least a window of equal words
        maybe = (periods * repeats <= len(ranks)) & blocks.same(level, places, places + periods)
        at, q = places[maybe], periods[maybe]
        start = at - blocks.left(at, at + q)
        length = at + q + blocks.right(at, at + q) - start
        whole = length >= np.maximum(least, repeats * q)
        found.update(zip(start[whole].tolist(), length[whole].tolist(), q[whole].tolist(), strict=True))
    yield from found


def periodic_runs(words: list, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``words`` are any values that can be told apart."""
    if least < 1 or repeats < 2:
        raise ValueError("Runs need at least one word and two periods")
    if len(words) < max(least, repeats):
        return []
    names: dict = {}
    ids = np.array([names.setdefault(word, len(names)) for word in words], np.int64)
    least, window = max(least, repeats), _window(least, repeats)
    found = [
        (start + s, length, q)
        for start, end in _stretches(ids, least, window)
        for s, length, q in _runs_of_stretch(ids[start:end], least, repeats, window)
    ]
    return sorted(found, key=lambda x: (x[0], x[2]))


def strongest(spans: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start, then period."""
    best = None
    for span in spans:
        if best is None or span[1] * best[2] > best[1] * span[2]:
            best = span
    return best


def _finder(least: int, repeats: int, with_text: bool) -> Callable[[], Callable[[bytes | None], tuple]]:
    def find(text: bytes | None) -> tuple:
        words = (text or b"").split()
        spans = periodic_runs(words, least, repeats)
        left = words
        if spans:
            marks = np.zeros(len(words) + 1, np.int64)
            for start, length, period in spans:
                marks[start + period] += 1
                marks[start + length] -= 1
            left = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
        collapsed = b" ".join(left)
        best = strongest(spans)
        names = ("start", "length", "period")
        if with_text and text is not None:
            text = text if len(left) == len(words) else collapsed
        return (
            len(words),
            len(words) - len(left),
            [dict(zip(names, span, strict=True)) for span in spans],
            dict(zip(names, best, strict=True)) if best else None,
            hashlib.sha256(collapsed).hexdigest(),
            text.decode("utf-8", "replace") if with_text and text is not None else None,
        )

    return lambda: find


def find_runs(
    docs: DataFrame,
    text_col: str = "text",
    least: int = LEAST,
    repeats: int = REPEATS,
    with_text: bool = False,
    into: str = "runs",
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_dropped, spans, strongest, collapsed_sha256, text_left.

    Words are those between ASCII white space. ``spans`` has (start, length, period) of each run by start, then period;
    a word is dropped if it lies in a run after that run's first period. ``collapsed_sha256`` is that of the words left, joined by one
    space. ``text_left``, only ``with_text``, is the text as it is if no word is dropped, else those words.

    A null or blank text has no words and no runs; its ``strongest`` is null and its ``text_left`` is null only if the text is. Rows that repeat an id,
    null ids and further columns of any name (other than ``into``, which is replaced) are kept as they are. An empty table gives no rows.
    """
    need_columns(docs, text_col)
    text: Column = F.col(f"`{text_col}`").cast("binary")
    return docs.withColumn(into, row_column(_finder(least, repeats, with_text), RUNS)(text))
