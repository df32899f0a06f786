"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much.

A line (split at ``\\n``) with at least one word fails if it is

* *symbols*: more than one of ``# * $ % & | < >`` per two words, three at least,
* *navigation*: three or more separators standing alone, making up a fifth of its words,
* *shouting*: more A-Z than a-z, with twenty A-Z at least, or a fifth of its words end in ``!!``,
* *stutter*: three or more words equal to the word before, making up three tenths of its words,
* *boilerplate*: it begins with one of a list of phrases and has at most 20 words,
* *unpunctuated*: 30 words or more without a single punctuation mark,
* *repeated*: it equals an earlier line of the document.

A document is kept if it passes the base rules (50 words, at most half of them in repeated windows
of three) and the lines that are left hold at least half of its words.

All rules are whole-number arithmetic over one document inside one task: no shuffle, no state.
Null text has no words and is not kept; empty and blank texts likewise. Repeated rows give repeated
results. Other columns, nulls among them, stay as they are; one called like the result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import WHITE_SPACE, need_columns, row_column

SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset({b"|", b">", b"<", b"/", b"-", "»".encode(), "·".encode(), "•".encode(), "›".encode()})
PUNCTUATION = b".,;:!?"
BOILERPLATE = re.compile(
    rb"\W*(?:licensed under|copyright|all rights reserved|cookie policy|privacy policy|terms of (?:use|service)"
    rb"|javascript|subscribe|sign (?:in|up)|log ?in|read more|click here|share this|follow us)\b",
    re.IGNORECASE,
)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class LineRules:
    """Limits of the document rules; the line rules are fixed by the list above."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_left_percent: int = 50


STATS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("n_words_left", T.LongType()),
        T.StructField("text_left", T.StringType()),
    ]
)


def _without(data: bytes, chars: bytes) -> int:
    return len(data.translate(None, chars))


def count_repeat_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def failed_rule(line: bytes) -> str | None:
    """The first rule of the list that a line with words fails, leaving out *repeated*."""
    words = line.split()
    n = len(words)
    symbols = len(line) - _without(line, SYMBOLS)
    if symbols >= 3 and 2 * symbols > n:
        return "symbols"
    separators = sum(word in SEPARATORS for word in words)
    if separators >= 3 and 5 * separators >= n:
        return "navigation"
    upper = len(line) - _without(line, UPPER)
    if upper >= 20 and upper > len(line) - _without(line, LOWER):
        return "shouting"
    loud = sum(word.endswith(b"!!") for word in words) if b"!!" in line else 0
    if loud >= 3 and 5 * loud >= n:
        return "shouting"
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if again >= 3 and 10 * again >= 3 * n:
        return "stutter"
    if n <= 20 and BOILERPLATE.match(line):
        return "boilerplate"
    if n >= 30 and _without(line, PUNCTUATION) == len(line):
        return "unpunctuated"
    return None


def judge(text: bytes | None, rules: LineRules, with_text: bool) -> tuple:
    """The values of ``STATS``."""
    text = text or b""
    words = text.split()
    n_words = len(words)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup_lines = left = 0
    good = []
    for line in lines:
        n = len(line.split())
        if not n:
            good.append(line)
            continue
        repeated = line in seen
        dup_lines += repeated
        seen.add(line)
        if not repeated and failed_rule(line) is None:
            left += n
            good.append(line)
    n_repeat = count_repeat_words(words)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and 100 * left >= rules.min_left_percent * n_words
    return (
        n_words,
        len(text.translate(None, WHITE_SPACE + CONTINUATION)),
        len(text) - _without(text, SYMBOLS),
        dup_lines,
        n_repeat,
        base_failed,
        kept,
        left,
        (text if left == n_words else b"\n".join(good)).decode("utf-8", "replace") if with_text else None,
    )


def apply_line_rules(
    docs: DataFrame,
    text_col: str = "text",
    rules: LineRules | None = None,
    with_text: bool = False,
    into: str = "lines",
) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``STATS``; its ``text_left`` only ``with_text``.

    Blank lines stay in ``text_left``, and a document without a failing line keeps its text as it is.
    """
    need_columns(docs, text_col)
    limits = rules or LineRules()

    def make() -> Callable[[bytes | None], tuple]:
        return lambda text: judge(text, limits, with_text)

    return docs.withColumn(into, row_column(make, STATS)(F.col(f"`{text_col}`").cast("binary")))
