"""Languages of documents as mixtures, by expectation-maximisation over n-gram likelihoods.

*Training.* Runs of three bytes of lower-cased words in UTF-8, with the words' ends marked by a space, are counted for each
language over all training documents, in ``BUCKETS`` buckets. Words are runs of ASCII letters and non-ASCII characters. Counts are summed within each task first; the
driver gets one smoothed table of languages x buckets, whose size does not depend on the corpus.

*Prediction.* The likelihood of a word under a language is the product over its n-grams. A
document is a mixture: expectation-maximisation finds the proportions of the languages that make its words
likeliest. The set of languages starts with the likeliest single one and grows by the one with the largest
proportion among the rest while that raises the likelihood by more than a penalty of ``penalty`` times the logarithm of the
number of words. The prediction is the language with the largest proportion in the set, the score its proportion.

Texts are read whole, in blocks of ``BLOCK_BYTES`` cut between words. A null text, or one without letters, is ``und`` with score 0. Null languages, and
rows without an id, are not learned from. Repeated rows count each. Without any training row all
predictions are ``und``. Other columns stay as they are; one called like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import BLOCK_BYTES, need_columns, record_batch, row_column, slices, to_arrow

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def _letter_bytes() -> bytes:
    """ASCII letters in lower case and non-ASCII bytes as they are; a space for all others."""
    lowered = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in lowered)


_LETTERS = _letter_bytes()


COUNTS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())]
)
MIXTURE = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("proportions", T.ArrayType(T.DoubleType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case."""
    data = text or b""
    if not data.isascii():
        data = data.decode("utf-8", "replace").lower().encode()
    return data.translate(_LETTERS).split()


def blocks_of(words: list[bytes]) -> Iterator[bytes]:
    """The words between single spaces, ``BLOCK_BYTES`` or one word at a time."""
    block, size = [], 0
    for word in words:
        block.append(word)
        size += len(word) + 1
        if size >= BLOCK_BYTES:
            yield b" " + b" ".join(block) + b" "
            block, size = [], 0
    if block:
        yield b" " + b" ".join(block) + b" "


def grams_of(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of a block's n-grams, which of them lie in a word, and where words begin among them."""
    data = np.frombuffer(block, np.uint8).astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    space = data == 32
    return code.astype(np.int64), ~space[1:-1], np.flatnonzero(space[:-2])


@dataclass(frozen=True)
class LanguageModel:
    """Log-probability of each bucket under each language."""

    languages: list[str]
    table: np.ndarray  # buckets x languages


def train(docs: DataFrame, lang_col: str, text_col: str, rows: Column) -> LanguageModel:
    """Learn from the documents for which ``rows`` holds and the language is known."""
    need_columns(docs, lang_col, text_col)
    schema = to_arrow(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for langs, texts in slices(batches):
            together: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                together.setdefault(lang, []).extend(words_of(text))
            for lang, words in together.items():
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for block in blocks_of(words):
                    code, inside, _ = grams_of(block)
                    total += np.bincount(code[inside], minlength=BUCKETS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield record_batch([[lang] * len(used), pa.array(used.astype(np.int32)), pa.array(total[used])], schema)

    chosen = docs.where(rows & F.col(f"`{lang_col}`").isNotNull())
    columns = chosen.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counted = columns.mapInArrow(count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).collect()
    languages = sorted(row["lang"] for row in found)
    table = np.full((BUCKETS, len(languages)), 0.1)
    for row in found:
        at = languages.index(row["lang"])
        pairs = np.array([(c["bucket"], c["n"]) for c in row["counts"]], np.int64).reshape(-1, 2)
        table[pairs[:, 0], at] += pairs[:, 1]
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def proportions(likely: np.ndarray, weights: np.ndarray, steps: int = 30, close: float = 1e-4) -> np.ndarray:
    """Mixture proportions by expectation-maximisation; ``likely`` is words x languages."""
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    total = weights.sum()
    for _ in range(steps):
        joint = likely * share
        new = (weights / joint.sum(axis=1)) @ joint / total
        done = np.abs(new - share).max() < close
        share = new
        if done:
            break
    return share


def mixture(logs: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """The selected languages, the largest first, and their proportions; ``logs`` is words x languages."""
    best = logs.max(axis=1, keepdims=True)
    likely = np.maximum(np.exp(logs - best), 1e-12)
    cost = penalty * np.log(weights.sum() + 1)
    singles = weights @ np.log(likely)
    chosen = [int(np.argmax(singles))]
    value, share = float(singles[chosen[0]]), np.ones(1)
    everything = proportions(likely, weights) if likely.shape[1] > 1 else share
    for candidate in np.argsort(-everything).tolist():
        if candidate in chosen:
            continue
        part = likely[:, [*chosen, candidate]]
        new_share = proportions(part, weights)
        new_value = float(weights @ np.log(part @ new_share))
        if new_value - value <= cost:
            break
        chosen, value, share = [*chosen, candidate], new_value, new_share
    order = np.argsort(-share, kind="stable")
    return [chosen[i] for i in order], share[order]


def word_logs(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The log-likelihood of each word under each language."""
    parts = []
    for block in blocks_of(words):
        code, inside, starts = grams_of(block)
        parts.append(np.add.reduceat(table[code] * inside[:, None], starts, axis=0))
    return np.concatenate(parts)


def _predictor(sent, penalty: float) -> Callable[[], Callable[[bytes | None], tuple]]:
    def make() -> Callable[[bytes | None], tuple]:
        model: LanguageModel = sent.value

        def row(text: bytes | None) -> tuple:
            words = words_of(text)
            if not words or not model.languages or not _LETTER.search((text or b"").decode("utf-8", "replace")):
                return UNKNOWN, 0.0, [], []
            logs = word_logs(words, model.table)
            chosen, share = mixture(logs, np.ones(len(logs), np.float32), penalty)
            return (
                model.languages[chosen[0]],
                float(min(1.0, share[0])),
                [model.languages[i] for i in chosen],
                share.tolist(),
            )

        return row

    return make


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    penalty: float = 3.0,
    into: str = "mixture",
) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``MIXTURE``."""
    need_columns(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = row_column(_predictor(sent, penalty), MIXTURE)
    return docs.withColumn(into, column(F.col(f"`{text_col}`").cast("binary")))
