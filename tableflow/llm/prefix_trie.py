"""The trie of conversation openings: one node for each distinct sequence of first turns, with totals of its subtree.

1. **Turns** become a digest of role and text and a count of words; texts are not shuffled. They are put in order over all tasks, so one
   very long conversation is spread over many. Its turns are numbered within a task's part, plus what earlier parts hold.
2. **Nodes.** A sequence of first turns is told by the sums of two 60-bit numbers, drawn by SHA-256 from place and digest of each of its
   turns; the sums are kept whole, and running sums add up over the parts. Counts of members are aggregations, combined in the map tasks. A
   node's name is (smallest member, depth).
3. **Totals of subtrees** by centroid decomposition of the forest of parent edges. A node weighs as much as it has members, so the
   weight of its whole subtree is the sum of its members' remaining turns, known without a walk. In a component of weight T, the nodes
   whose subtree within it weighs more than T / 2 are the path from the top to the centroid, the lowest of them. The values below the
   centroid are added up and given to that path; the subtrees below it and the rest above are components of their own. Weights halve,
   so the rounds are as many as the logarithm of all turns, however deep or wide the trie is. Components above
   ``COMPONENT`` are split by joins and aggregations, a round each; smaller ones are finished inside tasks.
4. **Members that end at a node** are hashed in numeric order: sorted over all tasks, joined to pieces, and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import need_columns, record_batch, to_arrow
from tableflow.sources.scratch import Scratch, written

#: The weight up to which a component is finished within a task; it has no more nodes than that.
COMPONENT = 1 << 15
#: Rows up to which a table with one row per split component is broadcast.
BROADCAST_ROWS = 10_000
#: Ids in a piece of a node's list of ends.
PIECE = 1_000

_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Opening:
    """Turns that a conversation takes from another one: its own first ``turns`` turns are replaced by as many
    of the first of conversation ``base``, as far as that has them. Both are Columns over ``conv``, the id."""

    base: Column
    turns: Column


def conversation_trie(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    opening: Opening | None = None,
    component: int = COMPONENT,
) -> tuple[DataFrame, str]:
    """One row per node, and the scratch folder that holds them.

    Columns: conv_id (the node's smallest member) and depth, which name it; parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, words of a node's last text times members but one), ends_sha256.

    Turns stand by ``turn_col``, null first; equal ones by the digest of role and text, and repeated rows are turns of their own. A null role or text is
    empty. Rows without a conversation id are left out. Without any other row there is no node. Ids are whole numbers. Further columns are not read.
    """
    need_columns(conversations, id_col, turn_col, role_col, text_col)
    if not isinstance(conversations.schema[id_col].dataType, T.IntegralType):
        raise ValueError("Ids must be whole numbers")
    scratch = Scratch(conversations.sparkSession)
    text, role = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text_col, role_col))
    turns = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    turns = scratch.keep(turns, "digests")  # else the range partitioner's sample would hash all texts once more
    prefixes, convs = _prefixes(_numbered(turns, scratch), opening, scratch)
    low = convs.agg(F.min("conv")).first()[0]
    nodes, members = _nodes(prefixes, convs, low, scratch)
    totals = rollup(nodes, members, low, ["leaf", "saved"], scratch, component)
    ends = members.where("depth = length").select(F.col("node").alias("conv"), "depth", F.col("conv").alias("member"))
    none = convs.where("length = 0").select(_number(low).alias("conv"), _number(0).alias("depth"), F.col("conv").alias("member"))
    ends = ends.unionByName(none)
    digests = scratch.keep(_digests(ends), "ends")
    result = nodes.join(totals, ["conv", "depth"]).join(digests, ["conv", "depth"], "left")
    result = result.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaf_total").alias("n_leaves"),
        F.col("saved_total").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    stored, path = written(result, "trie")
    scratch.drop()
    return stored, path


def _number(value: int | None) -> Column:
    return F.lit(value).cast("long")


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, part, pos, key, words): turns numbered from 1, each in a part of its conversation that one task holds."""
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    ranged = turns.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id().cast("long"))
    stored = scratch.keep(ranged, "turns")
    numbered = stored.withColumn("pos", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)).cast("long"))
    sizes = stored.groupBy("conv", "part").agg(F.count("*").alias("n"))
    joined = _with_earlier(numbered, sizes, ["n"], scratch)
    return joined.select("conv", "part", (F.col("pos") + F.col("n_earlier")).alias("pos"), "key", "words")


def _with_earlier(rows: DataFrame, sizes: DataFrame, columns: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rows`` with the sums of ``columns`` over earlier parts of the conversation as ``<column>_earlier``.

    A conversation comes from an earlier part at most once per part, so there are no more such rows than parts, and they are broadcast.
    """
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_earlier": F.sum(c).over(earlier) for c in columns}
    later = sizes.withColumns(sums).where(F.col(f"{columns[0]}_earlier").isNotNull())
    later = scratch.keep(later.select("conv", "part", *sums), "earlier")
    joined = rows.join(F.broadcast(later), ["conv", "part"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})


def _prefixes(turns: DataFrame, opening: Opening | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, a, b, words, length) for every first d turns, d > 0, and (conv, length) of all conversations."""
    turns = scratch.keep(turns, "numbered")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    if opening is None:
        convs = convs.withColumns({"own": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    else:
        convs = scratch.keep(convs.withColumns({"own": opening.turns.cast("long"), "base": opening.base}), "sizes")
        bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("has"))
        convs = convs.join(bases, "base", "left").withColumn("taken", F.least("own", F.coalesce("has", _number(0))))
    convs = scratch.keep(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("own"), F.lit(0))), "convs")
    known = convs.select("conv", "own", "taken", "length")
    rows = turns.join(known, "conv").where("pos > own")
    rows = rows.select("conv", "part", (F.col("pos") - F.col("own") + F.col("taken")).alias("depth"), "key", "words", "length")
    if opening is not None:
        longest = convs.agg(F.max("own")).first()[0] or 0
        first = turns.where(F.col("pos") <= longest).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "key", "words")
        opened = convs.join(first, "base").where("depth <= own")
        rows = rows.unionByName(opened.select("conv", "part", "depth", "key", "words", "length"))
    drawn = F.sha2(F.concat_ws(":", "depth", "key"), 256)
    number = lambda start: F.conv(F.substring(drawn, start, 15), 16, 10).cast("decimal(20,0)")
    rows = scratch.keep(rows.withColumns({"a": number(1), "b": number(16)}), "drawn")
    running = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({x: F.sum(x).over(running) for x in "ab"})
    parts = rows.groupBy("conv", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    joined = _with_earlier(summed, parts, ["a", "b"], scratch)
    whole = {x: (F.col(x) + F.col(f"{x}_earlier")).cast("decimal(38,0)") for x in "ab"}
    prefixes = scratch.keep(joined.withColumns(whole).select("conv", "depth", "a", "b", "words", "length"), "prefixes")
    return prefixes, convs.select("conv", "length")


def _nodes(prefixes: DataFrame, convs: DataFrame, low: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, parent, n_convs, n_children, weight, leaf, saved) of all nodes, and which node each (conv, depth) belongs to."""
    of = ["depth", "a", "b"]
    counted = scratch.keep(
        prefixes.groupBy(*of).agg(
            F.min("conv").alias("node"),
            F.count("*").alias("n_convs"),
            F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
            F.max("words").alias("words"),
        ),
        "counted",
    )
    members = scratch.keep(prefixes.join(counted.select(*of, "node"), of).select("conv", "depth", "node", "length"), "members")
    above = members.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    named = counted.select(F.col("node").alias("conv"), "depth", "n_convs", "weight", "words")
    named = named.join(above, ["conv", "depth"], "left")
    parent = F.when(F.col("depth") == 1, _number(low)).otherwise(F.col("parent"))
    below_root = scratch.keep(named.withColumn("parent", parent.cast("long")), "named")
    children = below_root.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))
    total = convs.agg(F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    root = total.select(
        _number(low).alias("conv"),
        _number(0).alias("depth"),
        "n_convs",
        "weight",
        _number(0).alias("words"),
        _number(None).alias("parent"),
    )
    nodes = below_root.unionByName(root).join(children, ["conv", "depth"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumns(
        {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    )
    return scratch.keep(nodes.drop("words"), "nodes"), members


# Totals of subtrees -----------------------------------------------------------------------------


def rollup(
    nodes: DataFrame, members: DataFrame, root: int | None, values: Sequence[str], scratch: Scratch, component: int = COMPONENT
) -> DataFrame:
    """(conv, depth, <value>_total): for each node the sums of ``values`` over its subtree, itself included.

    ``nodes`` has conv, depth, parent (the conv of the node above) and weight: that of the whole subtree, where every node weighs at
    least one; ``root`` is the conv of the one at depth 0. ``members`` names the node of each (conv, depth), depth 0 aside. See the module for the method.
    """
    sums = [f"{v}_total" for v in values]
    top = ["top_conv", "top_depth"]
    current = nodes.select("conv", "depth", "parent", "weight", *values, _number(root).alias("top_conv"), _number(0).alias("top_depth"))
    current = scratch.keep(current.withColumns({s: _number(0) for s in sums}), "components")
    columns, done = current.columns, []
    while True:
        is_top = (F.col("conv") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
        tops = current.where(is_top & (F.col("weight") > component)).select(*top, F.col("weight").alias("whole"))
        tops = scratch.keep(tops, "tops")
        n_tops = tops.count()
        if not n_tops:
            break
        small = (lambda df: F.broadcast(df)) if n_tops <= BROADCAST_ROWS else (lambda df: df)
        marked = current.join(small(tops), top).withColumn("on_path", 2 * F.col("weight") > F.col("whole"))
        lowest = marked.where("on_path").groupBy(*top).agg(
            F.min_by(F.struct("conv", "depth"), "weight").alias("c"), F.min("weight").alias("c_weight")
        )
        centroids = lowest.select(*top, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), "c_weight")
        centroids = scratch.keep(centroids, "centroids")
        placed = scratch.keep(_below(marked.join(small(centroids), top), members), "placed")
        totals = placed.where("below").groupBy(*top).agg(*(F.sum(v).alias(f"add_{v}") for v in values))
        totals = scratch.keep(totals, "totals")
        is_centroid = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        added = placed.join(small(totals), top).withColumns(
            {s: F.col(s) + F.when(F.col("on_path"), F.col(f"add_{v}")).otherwise(0) for s, v in zip(sums, values, strict=True)}
        )
        lighter = F.col("on_path") & ~is_centroid
        added = added.withColumns(
            {
                "weight": F.col("weight") - F.when(lighter, F.col("c_weight")).otherwise(0),
                "top_conv": F.when(F.col("below"), F.col("child")).otherwise(F.col("top_conv")),
                "top_depth": F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")),
                "finished": is_centroid,
            }
        )
        added = scratch.keep(added, "split")
        done.append(added.where("finished").select("conv", "depth", *sums))
        rest = current.join(small(tops.select(*top)), top, "left_anti")
        current = scratch.keep(rest.unionByName(added.where("NOT finished").select(*columns)), "components")
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("conv", "depth", *sums)])
    n = len(values)
    dealt = current.select(*top, "depth", "conv", "parent", "weight", *values, *sums).repartition(*top)
    result = dealt.sortWithinPartitions(*top, "depth").mapInArrow(_finisher(n, schema), schema)
    for part in done:
        result = result.unionByName(part)
    return scratch.keep(result, "totals")


def _below(marked: DataFrame, members: DataFrame) -> DataFrame:
    """Adds whether a node is below the centroid or is it, and which child of the centroid it is below."""
    at = members.select(F.col("conv"), F.col("depth").alias("c_depth"), F.col("node").alias("at_c"))
    child = members.select(F.col("conv"), (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("child"))
    joined = marked.join(at, ["conv", "c_depth"], "left").join(child, ["conv", "c_depth"], "left")
    below = (F.col("depth") >= F.col("c_depth")) & ((F.col("c_depth") == 0) | (F.col("at_c") == F.col("c_conv")))
    return joined.withColumn("below", F.coalesce(below, F.lit(False)))


def add_up(parents: list[int], weights: list[int], values: list[list[int]], sums: list[list[int]]) -> None:
    """Adds to ``sums`` the subtree totals of ``values`` in one tree, by centroids. ``weights``, those of subtrees, are used up.

    Nodes stand by depth; ``parents`` are places, anything for the first node.
    """
    side = [0] * len(parents)
    parts = [list(range(len(parents)))] if parents else []
    while parts:
        part = parts.pop()
        half = weights[part[0]] / 2
        path = [v for v in part if weights[v] > half]
        centroid = path[-1]
        below, above, children = [centroid], [], {}
        for v in part:
            if v == centroid:
                side[v] = -2
            elif v == part[0]:
                side[v] = -1
            else:
                p = parents[v]
                side[v] = v if p == centroid else side[p]
            if side[v] == -1:
                above.append(v)
            elif v != centroid:
                below.append(v)
                children.setdefault(side[v], []).append(v)
        for value, total in zip(values, sums, strict=True):
            add = sum(value[v] for v in below)
            for v in path:
                total[v] += add
        for v in path[:-1]:
            weights[v] -= weights[centroid]
        parts += [x for x in (above, *children.values()) if x]


def _finisher(n: int, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of whole components that come one after another, each by depth."""
    arrow = to_arrow(schema)

    def finish(rows: list[tuple]) -> list[tuple]:
        places = {(r[2], r[3]): i for i, r in enumerate(rows)}
        parents = [places.get((r[2] - 1, r[4]), -1) for r in rows]
        columns = [list(x) for x in zip(*rows, strict=True)]
        sums = columns[6 + n :]
        add_up(parents, columns[5], columns[6 : 6 + n], sums)
        return list(zip(columns[3], columns[2], *sums, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    out += finish(held)
                    held = []
                held.append(row)
            if out:
                yield record_batch(list(zip(*out, strict=True)), arrow)
        if held:
            yield record_batch(list(zip(*finish(held), strict=True)), arrow)

    return run


# Ends -------------------------------------------------------------------------------------------

_PIECE = T.StructType(
    [*(T.StructField(x, T.LongType()) for x in ("conv", "depth", "first")), T.StructField("ids", T.StringType())]
)
_DIGEST = T.StructType(
    [*(T.StructField(x, T.LongType()) for x in ("conv", "depth")), T.StructField("sha256", T.StringType())]
)


def _digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, sha256) over the comma-joined members of each node, by number."""
    order = ["conv", "depth", "member"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(_pieces, _PIECE)
    dealt = pieces.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return dealt.mapInArrow(_hashes, _DIGEST)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow(_PIECE)
    for batch in batches:
        out: list[tuple] = []
        held: list[int] = []
        node = None
        for conv, depth, member in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and (node != (conv, depth) or len(held) == PIECE):
                out.append((*node, held[0], ",".join(map(str, held))))
                held = []
            node = conv, depth
            held.append(member)
        if held:
            out.append((*node, held[0], ",".join(map(str, held))))
        if out:
            yield record_batch(list(zip(*out, strict=True)), arrow)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow(_DIGEST)
    node, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        for conv, depth, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if node == (conv, depth):
                digest.update(b"," + ids.encode())
                continue
            if digest:
                out.append((*node, digest.hexdigest()))
            node, digest = (conv, depth), hashlib.sha256(ids.encode())
        if out:
            yield record_batch(list(zip(*out, strict=True)), arrow)
    if digest:
        yield record_batch(list(zip(*[(*node, digest.hexdigest())], strict=True)), arrow)
