"""Connected components of a table of links, by alternating star contractions.

Each iteration replaces every link by one to the smallest neighbour seen from its larger end (large
star) and from its smaller end (small star). The number of links never grows, and a few iterations
suffice for shallow groups. Minima are combined in the map tasks and stored, so that the joins that bring them back
are plain ones, which adaptive execution splits at hot ids. Links are written to the shared folder
after each iteration, so that lineage stays short and a lost executor costs one iteration at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.sources.scratch import Scratch, written


def connected_components(links: DataFrame) -> tuple[DataFrame, str]:
    """(id, component) for every id in ``links`` (a, b), and the scratch folder that holds it.

    The component is the smallest id that can be reached. Links of an id with itself, and links with a
    null, count for nothing; repeated links count once. No links give an empty table.
    """
    spark = links.sparkSession
    before, now = Scratch(spark), Scratch(spark)
    current = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = before.keep(current.distinct(), "links")
    state, last = _state(current), None
    while state[0] and state != last:
        current = now.keep(_small_star(_large_star(current, now), now), "links")
        last, state = state, _state(current)
        before.drop()
        # of the tables of this step, only the links themselves are read again
        before, now = now, before
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    found = current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
    stored, path = written(found, "components")
    before.drop()
    return stored, path


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = both.join(least, "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.keep(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()
