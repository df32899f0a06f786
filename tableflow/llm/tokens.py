"""Ids of a tokenizer file, with the ids of the parts of words kept between texts.

The tokenizer splits at white space before anything else and normalises each side on its own, so
the ids of a text are those of its words in a row. ``WordTokenizer`` checks that the file
is of that kind and encodes whole texts where it isn't.

Most words are lower-cased and split here by the same rules, a block of texts at a time on arrays, and only parts that were not seen before
go to the tokenizer's model. That holds for words of letters whose lower case and composed form need no
context (ASCII and Latin-1); any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

from tableflow.llm.common import WHITE_SPACE

_SIMPLE = re.compile(r"[\x20-\x7e\xa1-\xac\xae-\xff\t-\r]*")
_WORDS = re.compile(r"[^ \t-\r]+")
_PARTS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for a word that goes through the whole tokenizer. No other word that is split here holds it.
_ODD = "\x01"


def _kinds() -> np.ndarray:
    """What a character of Latin-1 is to the pattern. Each number, and each odd word, is a part of its own."""
    text = bytes(range(256)).decode("latin-1")
    out = np.full(256, _SIGN, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_WHITE, r"[ \t-\r]"), (_NUMBER, _ODD)):
        out[[m.start() for m in regex.finditer(pattern, text)]] = kind
    return out


_WHITE, _LETTER, _SIGN, _NUMBER = range(4)
_KINDS = _kinds()
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class WordTokenizer:
    """Encodes texts by parts of words. The table of known parts starts anew when full."""

    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, max_words: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (
            kinds == _NORMALIZERS
            and first.get("type") == "Split"
            and first.get("invert") is True
            and first.get("behavior") == "Removed"
            and first.get("pattern") == {"Regex": _PARTS_PATTERN}
        )
        self.special = tuple(x["content"] for x in spec.get("added_tokens", []))
        self.max_words = max_words
        #: ids of parts, in Latin-1, and of odd words
        self.known: dict[bytes | str, bytes] = {}
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = self.by_word and bool(suffix)
        if self.by_word:
            #: ids that end a part; no part holds the suffix as text, since letters and signs are split
            vocab = self.whole.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[n for token, n in vocab.items() if token.endswith(suffix)]] = True
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.WhitespaceSplit(),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
                ]
            )

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One tokenizer for each worker process and file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, texts: Iterable[bytes | None], block: int = 1 << 21) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers. Texts are split ``block`` bytes at a time."""
        held, size = [], 0
        for text in texts:
            text = text or b""
            if not self.by_word:
                yield _pack(self.whole.encode(text.decode(), add_special_tokens=False).ids)
                continue
            if size + len(text) > block:
                yield from self._encode(held)
                held, size = [], 0
            if len(text) > block:
                yield b"".join(ids for piece in _pieces(text, block) for ids in self._encode([piece]))
            else:
                held.append(text)
                size += len(text)
        yield from self._encode(held)

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        odd: list[str] = []
        plain = [self._plain(text.decode("utf-8", "replace"), odd) for text in texts]
        starts, parts = _split("\n".join([*plain, ""]))
        coded = parts.dictionary_encode()
        keys, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if odd:
            marks = np.flatnonzero(index == keys.index(_ODD.encode()))
            index, keys = index.copy(), keys + odd
            index[marks] = np.arange(len(keys) - len(odd), len(keys))
        found = list(map(self.known.get, keys))
        if new := {key for key, ids in zip(keys, found, strict=True) if ids is None}:
            learned = self._learn(new)
            found = [learned[key] if ids is None else ids for key, ids in zip(keys, found, strict=True)]
        ids = pa.array(found, pa.binary()).take(pa.array(index))
        _, offsets, data = ids.buffers()
        ends = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in plain]))
        at = 0
        for end in np.frombuffer(offsets, np.int32)[ends].tolist() if len(ids) else [0] * len(texts):
            yield data[at:end].to_pybytes() if end > at else b""
            at = end

    def _plain(self, text: str, odd: list[str]) -> str:
        """The text with a mark in place of each odd word; those go to ``odd``."""
        if self._simple(text):
            return text
        words = _WORDS.findall(text)
        for i, word in enumerate(words):
            if not self._simple(word):
                odd.append(word)
                words[i] = _ODD
        return " ".join(words)

    def _simple(self, text: str) -> bool:
        return _SIMPLE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _learn(self, new: set[bytes | str]) -> dict[bytes | str, bytes]:
        ids = {key: _pack(self.whole.encode(key, add_special_tokens=False).ids) for key in new if isinstance(key, str)}
        parts = [key for key in new if isinstance(key, bytes)]
        for i in range(0, len(parts), 500):
            ids.update(self._learn_parts(parts[i : i + 500]))
        if len(self.known) + len(ids) > self.max_words:
            self.known.clear()
        self.known.update(ids)
        return ids

    def _learn_parts(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        text = b" ".join(parts).decode("latin-1")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        return zip(parts, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)


def _split(text: str) -> tuple[np.ndarray, pa.Array]:
    """Where the parts of a text begin, and the parts, lower-cased and in Latin-1."""
    data = np.frombuffer((text.lower() + "\n\n\n").encode("latin-1"), np.uint8)
    kind = _KINDS[data]
    first = kind == _NUMBER
    first[0] |= kind[0] != _WHITE
    first[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != _WHITE)
    # an apostrophe that begins a run of signs takes the letters of a short ending with it
    quote = np.flatnonzero((data == ord("'")) & first)
    one, two = data[quote + 1], data[quote + 1] * np.uint16(256) + data[quote + 2]
    length = 2 * np.isin(one, list(b"stmd")) + 3 * np.isin(two, [256 * a + b for a, b in (b"re", b"ve", b"ll")])
    quote, after = quote[length > 0], (quote + length)[length > 0]
    first[quote + 1] = False
    first[after[kind[after] == _LETTER]] = True
    starts, black = np.flatnonzero(first), kind != _WHITE
    offsets = np.append(np.cumsum(black, dtype=np.int32)[starts] - 1, np.count_nonzero(black)).astype(np.int32)
    return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[black])])


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """Pieces of ``most`` bytes or more, up to the end of a word."""
    start = 0
    while start < len(text):
        end = min(len(text), start + most)
        while end < len(text) and text[end] not in WHITE_SPACE:
            end += 1
        yield text[start:end]
        start = end


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()
