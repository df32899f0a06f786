"""URL verdicts: given rules first, then a tree of path templates judged by labelled purity.

*Rules* are strings of a host and a path, like ``net/`` or ``example.org/en/``. A rule fits its host and all
subdomains if the path begins with the rule's; the longest fitting rule wins (of equally long ones, a
block).

*Templates.* Segments that look variable (numbers, long hexadecimal strings) are replaced by
a mark of their kind, so that the urls of a host become a few shapes with counts, built with one aggregation
that combines in the map tasks. All further work is on shapes. From the root of each host down, one level at a time,

1. a segment becomes ``*`` if its branch has more than ``max_children`` children and it has less than
   ``min_share`` of their pages,
2. the other branches, fewer than ``max_children`` or so, are put apart by their shares of good labelled pages: those that
   lie ``similar_z`` standard errors below ``min_purity`` or more, those that lie as far above, and those in between. In the order of
   their shares, neighbours of one kind that differ by less than ``similar_z`` standard errors are merged into one, ``(a|b)``, but those in
   between only where each has fewer than ``enough`` labelled pages. So no chain of neighbours joins clearly bad with clearly
   good branches, and a branch that its own labels can judge is not judged by others. Those without labelled pages are one as well.

This goes on for as long as a path has segments left. A branch with a single shape can't be split any more and takes the
rest of its path at once, so that there are as many levels as different shapes share. What is left are templates. Their purity is the share of
good pages among labelled ones, smoothed by the host's, which is smoothed by that of all pages, with a
weight of ``smoothing`` pages. Templates with a purity below ``min_purity`` are rejected. Every page has a
template, with labels or without; one without labels has the purity of its host.

All steps are joins and aggregations on keys. A host with a third of all pages is a few rows per map task in the
aggregations, and adaptive execution can split its rows in the last join. Nothing is collected.

A null url, or one without ``://``, has an empty host and path, which is a host like others. Labels other than 0 and
1 count for nothing, repeated labels of an id count each. Repeated rows give repeated results. An empty table
gives no rows. Other columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import need_columns
from tableflow.sources.scratch import drop_scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
VARIABLE = ((r"[0-9]+", "{n}"), (r"(?<=/)[0-9a-f]{16,}(?=/|$)", "{hex}"))


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that begin with the rule's path."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


@dataclass(frozen=True)
class TreeLimits:
    """When segments become wildcards, branches merge, and templates are rejected."""

    max_children: int = 50
    min_share: float = 0.05
    similar_z: float = 2.0
    smoothing: float = 10.0
    min_purity: float = 0.5
    enough: int = 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if it is null or has no ``://``."""
    host = F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def by_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The winning rule's text and verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), not r.allow, r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit("allow" if rule.allow else "block")).otherwise(verdict)
    return text, verdict


def path_shape(path: Column) -> Column:
    """The path with variable segments, or variable parts of them, replaced by marks."""
    for pattern, mark in reversed(VARIABLE):
        path = F.regexp_replace(path, pattern, mark)
    return path


def template_verdicts(shapes: DataFrame, limits: TreeLimits) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, pages, labelled, good), a stored table."""
    tree = shapes.withColumn("segments", F.split("shape", "/")).withColumn("template", F.lit(""))
    paths: list[str] = []
    depth = 0
    while depth < (tree.agg(F.max(F.size("segments"))).first()[0] or 0):
        tree, path = written(_one_level(tree, depth, limits), "level")
        drop_scratch(tree.sparkSession, *paths)
        paths = [path]
        depth += 1
    total = shapes.agg(F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
    weight = F.lit(limits.smoothing)
    prior = (F.col("all_good") + 1) / (F.col("all_labelled") + 1)
    host_purity = (F.col("host_good") + weight * prior) / (F.col("host_labelled") + weight)
    purity = (F.col("g") + weight * host_purity) / (F.col("l") + weight)
    judged = leaves.join(hosts, "host").join(F.broadcast(total)).select("host", "template", purity.alias("purity"))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"])


def _one_level(tree: DataFrame, depth: int, limits: TreeLimits) -> DataFrame:
    segment = F.get("segments", F.lit(depth))
    level = tree.withColumn("segment", segment)
    children = level.groupBy("host", "template", "segment").agg(
        F.sum("pages").alias("p"), F.sum("labelled").alias("l"), F.sum("good").alias("g"), F.count("*").alias("shapes")
    )
    nodes = children.groupBy("host", "template").agg(
        F.count("segment").alias("children"), F.sum("p").alias("np"), F.sum("l").alias("nl"), F.sum("g").alias("ng")
    )
    variable = (F.col("children") > limits.max_children) & (F.col("p") < limits.min_share * F.col("np"))
    ends = F.col("segment").isNull() | (F.col("segment") == "")
    known = children.join(nodes, ["host", "template"]).withColumn(
        "kind", F.when(ends, "end").when(variable, "variable").when(F.col("l") == 0, "unlabelled").otherwise("labelled")
    )
    rate = (F.col("g") + 1) / (F.col("l") + 2)
    known = known.withColumn("rate", rate).withColumn("error", rate * (1 - rate) / F.greatest("l", F.lit(1)))
    margin = limits.similar_z * F.sqrt("error")
    low, high = F.col("rate") + margin < limits.min_purity, F.col("rate") - margin > limits.min_purity
    known = known.withColumn("side", F.when(F.col("kind") != "labelled", 0).when(low, -1).when(high, 1).otherwise(0))
    in_order = Window.partitionBy("host", "template", "kind", "side").orderBy("rate", "segment")
    gap = F.col("rate") - F.lag("rate").over(in_order)
    limit = limits.similar_z * F.sqrt(F.col("error") + F.lag("error").over(in_order))
    judged_alone = (F.col("side") == 0) & (F.greatest("l", F.lag("l").over(in_order)) >= limits.enough)
    apart = (F.col("kind") == "labelled") & F.coalesce((gap > limit) | judged_alone, F.lit(False))
    kept = known.where("kind IN ('labelled', 'unlabelled')")
    grouped = kept.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(in_order))
    members = Window.partitionBy("host", "template", "kind", "side", "group")
    names = F.sort_array(F.collect_list("segment").over(members))
    joined = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("("), F.array_join(names, "|"), F.lit(")")))
    alone = F.sum("shapes").over(members) == 1
    labels = grouped.select(
        "host", "template", "segment", F.concat(F.lit("/"), joined).alias("label"), alone.alias("alone")
    ).unionByName(
        known.where("kind IN ('end', 'variable')").select(
            "host", "template", "segment", F.when(F.col("kind") == "end", "").otherwise("/*").alias("label"), F.lit(False).alias("alone")
        )
    )
    labels = labels.withColumn("segment", F.coalesce("segment", F.lit("\0")))
    keyed = level.withColumn("segment", F.coalesce("segment", F.lit("\0")))
    named = keyed.join(labels, ["host", "template", "segment"])
    after = F.filter(F.slice("segments", F.lit(depth + 2), F.greatest(F.size("segments"), F.lit(0))), lambda s: s != "")
    rest = F.when(F.col("alone"), F.concat_ws("", F.transform(after, lambda s: F.concat(F.lit("/"), s)))).otherwise("")
    left = F.when(F.col("alone"), F.slice("segments", 1, depth + 1)).otherwise(F.col("segments"))
    named = named.withColumn("template", F.concat("template", "label", rest)).withColumn("segments", left)
    return named.drop("segment", "label", "alone")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    limits: TreeLimits | None = None,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every page.

    ``labels`` has a page's id and ``good``, 1 or 0.
    """
    need_columns(pages, id_col, url_col)
    need_columns(labels, id_col, "good")
    most = limits or TreeLimits()
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", path_shape(F.col("path")))
    known = labels.select(F.col(f"`{id_col}`").alias("page_id"), "good").where("good IN (0, 1)")
    known = known.groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum("good").alias("good"))
    counted = rows.join(known, "page_id", "left").groupBy("host", "shape")
    shapes, _ = written(
        counted.agg(
            F.count("*").alias("pages"),
            F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        ),
        "shapes",
    )
    templates, _ = written(template_verdicts(shapes, most), "templates")
    rule, verdict = by_rule(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("purity") < most.min_purity, "block").otherwise("allow")
    return rows.join(templates, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "template", "purity"
    )
