"""Vector bin packing of token sequences with the dot-product heuristic.

A bin, here a sequence, has three limits at once: tokens, segments (pieces) and loss-bearing
tokens. A task packs the documents it reads, a bounded *group* of them at a time:

1. Pieces as long as a whole sequence are cut off long documents; the rests are the items.
2. The item that fits the open sequence and has the largest dot product of its demands (tokens, one segment, loss-bearing tokens) and
   what is left, each as a share of its limit, is placed next. For plain documents all tokens bear loss, so length alone decides;
   for conversations, where some turns do, the limits pull apart. Items with equal demands are one kind, so a
   step costs as much as there are kinds (a few thousand at most), not items.
3. If none fits, the item with the largest product of all is cut to fill the sequence, and the rest
   of it becomes an item. The last segment of a sequence goes to an item that fills it, if there is one.
4. The last sequence of a group may end half empty. It is dealt into sequences whose lengths are powers
   of two, which need no padding, unless it lacks fewer than ``min_tail`` tokens.

Groups end with ``group_tokens`` tokens, at the end of a task's input, or before, so memory is bounded
by the group and the longest document. There is no shuffle. A sequence's number is made of the task's
partition and a running number, and a task that runs again over the same split makes the same pieces.

Null text is the empty text: its only id is the end id. Null document ids pass through. Repeated rows are
separate documents. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import id_and_text, need_columns, record_batch, slices, to_arrow
from tableflow.llm.tokens import WordTokenizer


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. Loss-bearing tokens are those predicted from one before them in
    the same piece, so a piece of n tokens that all count bears n - 1."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass(frozen=True)
class Placed:
    """A piece: ``length`` tokens of ``item`` from ``start``, at ``offset`` of sequence ``bin``."""

    item: int
    start: int
    length: int
    bin: int
    offset: int


class _Pool:
    """Items not yet placed, by kind: (tokens, loss-bearing tokens)."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.table = np.empty((0, 3))
        self.stale = True
        self.n = 0

    def add(self, item: int, start: int, tokens: int, loss: int) -> None:
        key = (tokens, loss)
        members = self.kinds.setdefault(key, [])
        self.stale |= not members
        members.append((item, start))
        self.n += 1

    def demands(self) -> np.ndarray:
        if self.stale or self.dead > len(self.table) // 4 + 16:
            self.kinds = {k: v for k, v in self.kinds.items() if v}
            self.keys = list(self.kinds)
            self.table = np.array([(tokens, 1, loss) for tokens, loss in self.keys], np.float64).reshape(-1, 3)
            self.alive = np.ones(len(self.keys), bool)
            self.stale, self.dead = False, 0
        return self.table

    def take(self, at: int) -> tuple[int, int, int, int]:
        key = self.keys[at]
        item, start = self.kinds[key].pop()
        if not self.kinds[key]:
            self.alive[at] = False
            self.dead += 1
        self.n -= 1
        return item, start, *key

    def best(self, tokens: int, segments: int, loss: int) -> tuple[int, bool]:
        """The kind to place, and whether it must be cut; -1: nothing can be placed."""
        table = self.demands()
        fits = self.alive & (table[:, 0] <= tokens) & (table[:, 2] <= loss)
        if segments == 1:
            fits &= table[:, 0] == tokens
        most = self.limits
        left = np.array([tokens / most.tokens**2, segments / most.segments**2, loss / most.loss**2])
        score = table @ left
        if fits.any():
            return int(np.argmax(np.where(fits, score, -1.0))), False
        more = self.alive & ((table[:, 0] > tokens) | (table[:, 2] > loss))
        if more.any():
            return int(np.argmax(np.where(more, score, -1.0))), True
        return (int(np.argmax(np.where(self.alive, score, -1.0))), False) if self.alive.any() else (-1, False)


def _bears(length: int, loss_share: float) -> int:
    return int((length - 1) * loss_share) if length > 1 else 0


def pack(sizes: Sequence[int], limits: Limits, loss: Sequence[int] | None = None, cut: bool = True) -> list[Placed]:
    """Place items of ``sizes`` tokens. ``loss``: their loss-bearing tokens, by default all but the first.

    With ``cut``, items may be split, and the loss-bearing tokens of a piece are its share, rounded
    down. Without, an item over a limit raises. Offsets in a bin run from 0 without gaps.
    """
    out: list[Placed] = []
    pool = _Pool(limits)
    shares = [1.0] * len(sizes) if loss is None else [b / max(1, n - 1) for n, b in zip(sizes, loss, strict=True)]
    n_bins = 0

    def bears(item: int, length: int) -> int:
        return _bears(length, shares[item]) if cut or loss is None else loss[item]

    for item, size in enumerate(sizes):
        start = 0
        while cut and size - start >= limits.tokens and bears(item, limits.tokens) <= limits.loss:
            out.append(Placed(item, start, limits.tokens, n_bins, 0))
            n_bins, start = n_bins + 1, start + limits.tokens
        if size > start:
            if not cut and (size > limits.tokens or bears(item, size) > limits.loss):
                raise ValueError(f"Item {item} is over a limit")
            pool.add(item, start, size - start, bears(item, size - start))
    while pool.n:
        at, tokens, segments, left = 0, limits.tokens, limits.segments, limits.loss
        while tokens and segments and pool.n:
            kind, split = pool.best(tokens, segments, left)
            if kind < 0 or (split and not cut):
                break
            item, start, size, demand = pool.take(kind)
            if size > tokens or demand > left:
                length = min(size, tokens)
                while length and bears(item, length) > left:
                    length -= 1 + int((bears(item, length) - left) / max(shares[item], 1e-9) / 2)
                if length <= 0:
                    pool.add(item, start, size, demand)
                    break
                pool.add(item, start + length, size - length, bears(item, size - length))
                size, demand = length, bears(item, length)
            out.append(Placed(item, start, size, n_bins, at))
            at, tokens, segments, left = at + size, tokens - size, segments - 1, left - demand
        if not at:
            raise ValueError("Limits leave no room for a single token")
        n_bins += 1
    return out


def split_tail(pieces: list[Placed], limits: Limits, min_tail: int) -> list[Placed]:
    """Deal the pieces of each part-filled bin into bins whose lengths are powers of two.

    Only bins that would need ``min_tail`` or more positions of padding are dealt anew, into the
    powers of two that add up to what they hold.
    """
    filled: dict[int, int] = {}
    for p in pieces:
        filled[p.bin] = max(filled.get(p.bin, 0), p.offset + p.length)
    out = [p for p in pieces if limits.tokens - filled[p.bin] < min_tail]
    n_bins = max(filled, default=-1) + 1
    for p_bin, total in filled.items():
        if limits.tokens - total < min_tail:
            continue
        room = 1 << (total.bit_length() - 1)
        target, at, left = p_bin, 0, total
        for p in sorted((p for p in pieces if p.bin == p_bin), key=lambda p: p.offset):
            start, length = p.start, p.length
            while length:
                n = min(length, room - at)
                out.append(Placed(p.item, start, n, target, at))
                start, length, at, left = start + n, length - n, at + n, left - n
                if at == room and left:
                    target, n_bins, at = n_bins, n_bins + 1, 0
                    room = 1 << (left.bit_length() - 1)
    return out


PIECES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("token_ids", T.BinaryType()),
    ]
)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits | None = None,
    end_id: int = 1,
    group_tokens: int = 4_000_000,
    min_tail: int = 64,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: document, place in it, checksum of its ids, sequence and place there.

    ``with_ids``: also the piece's ids, as little-endian unsigned 32-bit numbers. All tokens of a document bear loss; for texts of which only
    a part does, see :func:`pack_conversations`.
    """
    most, schema = limits or Limits(), to_arrow(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.shared(tokenizer_file)
        end = int(end_id).to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 32
        for group in _groups(batches, tokenizer, end, group_tokens):
            sizes = [len(ids) // 4 for _, ids in group]
            pieces = split_tail(pack(sizes, most), most, min_tail)
            for i in range(0, len(pieces), 4096):
                yield record_batch(list(_columns(pieces[i : i + 4096], group, sizes, first, with_ids)), schema)
            first += 1 + max(p.bin for p in pieces)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def _groups(batches: Iterable, tokenizer: WordTokenizer, end: bytes, most: int) -> Iterator[list[tuple]]:
    """Documents with their ids' bytes, until a group has ``most`` tokens."""
    group, tokens, waiting = [], 0, deque()

    def all_texts() -> Iterator[bytes | None]:
        for doc_ids, texts in slices(batches):
            waiting.extend(doc_ids)
            yield from texts

    for ids in tokenizer.encode(all_texts()):
        group.append((waiting.popleft(), ids + end))
        tokens += len(ids) // 4 + 1
        if tokens >= most:
            yield group
            group, tokens = [], 0
    if group:
        yield group


def _columns(pieces: list[Placed], group: list, sizes: list[int], first: int, with_ids: bool) -> Iterator[list]:
    parts = [group[p.item][1][4 * p.start : 4 * (p.start + p.length)] for p in pieces]
    yield [group[p.item][0] for p in pieces]
    yield [p.start for p in pieces]
    yield [p.length for p in pieces]
    yield [zlib.crc32(part) for part in parts]
    yield [sizes[p.item] for p in pieces]
    yield [first + p.bin for p in pieces]
    yield [p.offset for p in pieces]
    yield parts if with_ids else [None] * len(parts)


# Instruction data -------------------------------------------------------------------------------

TURNS = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("conv_id", "first_turn", "turns", "start", "length", "loss", "sequence_id", "offset")]
)


@dataclass
class _Stretch:
    """Turns of one conversation in a row that go into a sequence together."""

    conv: int
    first: int | None
    turns: int = 0
    start: int = 0
    length: int = 0
    loss: int = 0


def pack_conversations(
    conversations: DataFrame,
    tokenizer_file: str,
    limits: Limits,
    loss_roles: Sequence[str] = ("assistant",),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    end_id: int = 1,
    group_tokens: int = 1_000_000,
) -> DataFrame:
    """Conversations in sequences under limits on tokens, segments and tokens that bear loss, all at once.

    A turn is its text's ids and the end id; those of ``loss_roles`` bear loss, all others only take room. One row per segment, a stretch of turns of
    one conversation: conv_id, first_turn, turns, start (tokens of its first turn that went before, if that was cut), length, loss, sequence_id, offset. A
    conversation is one segment if it keeps the limits; else it is cut between turns, and a turn over a limit is cut within.

    Turns are put in order over all tasks, so a very long conversation is spread over several, and cut where a task's part ends. Turns stand by
    ``turn_col``, null first, then by role and text. A null role or text is empty, rows without a conversation id form a conversation, and an
    empty table gives no segments.
    """
    need_columns(conversations, id_col, turn_col, role_col, text_col)
    most, schema, bearing = limits, to_arrow(TURNS), frozenset(loss_roles)

    def stretches(batches: Iterator[pa.RecordBatch], tokenizer: WordTokenizer) -> Iterator[_Stretch]:
        now: _Stretch | None = None
        for convs, turns, roles, texts in slices(batches):
            encoded = tokenizer.encode([t or b"" for t in texts])
            for conv, turn, role, ids in zip(convs, turns, roles, encoded, strict=True):
                left, bears = len(ids) // 4 + 1, (role or "") in bearing
                if now and (now.conv != conv or now.length + left > most.tokens or now.loss + bears * left > most.loss):
                    yield now
                    now = None
                done, longest = 0, min(most.tokens, most.loss) if bears else most.tokens
                while left - done > longest:
                    yield _Stretch(conv, turn, 1, done, longest, bears * longest)
                    done += longest
                now = now or _Stretch(conv, turn, start=done)
                now.turns, now.length, now.loss = now.turns + 1, now.length + left - done, now.loss + bears * (left - done)
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> tuple[pa.RecordBatch, int]:
            placed = pack([s.length for s in held], most, [s.loss for s in held], cut=False)
            rows = [
                (s.conv, s.first, s.turns, s.start, s.length, s.loss, first + p.bin, p.offset) for p in placed for s in [held[p.item]]
            ]
            return record_batch(list(zip(*rows, strict=True)), schema), 1 + max(p.bin for p in placed)

        for stretch in stretches(batches, WordTokenizer.shared(tokenizer_file)):
            held.append(stretch)
            tokens += stretch.length
            if tokens >= group_tokens:
                batch, used = packed()
                yield batch
                first, held, tokens = first + used, [], 0
        if held:
            yield packed()[0]

    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
    )
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TURNS)
