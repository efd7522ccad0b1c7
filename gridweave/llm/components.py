"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

EDGES = 100_000  # that a task of a round is given, where there are more than a few
TASKS = 8  # of a round, at least


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b``; the component is its smallest node.

    Large and small stars in turn: each round, every node tells its larger (then its smaller) neighbours
    the smallest node it knows, until all edges of a component meet in that node. Rounds grow with the logarithm
    of the longest path. Only minima are aggregated, so tasks combine them before the shuffle, and a node with
    very many neighbours is one row per task there. Minima are written before edges meet them, so Spark broadcasts them where
    they are few and else splits the edges of such a node over tasks. Each round is a written table in the shared folder, and rounds end as
    soon as all components are stars. The tasks of a round grow with the edges, not with the session's shuffle partitions. Edges from a
    node to itself, repeated ones and ones with a null end are allowed; the latter are left out.
    """
    now = stored(_ordered(edges.select("a", "b")), "edges")
    while True:
        rows, ended = _state(now)
        if ended:
            break
        tasks = TASKS + rows // EDGES
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(tasks), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = stored(large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(tasks), "down")
        least = stored(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("u", "m"))
        now = stored(_ordered(small).coalesce(tasks), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a")).distinct()


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` once more links ``a, b`` are known: only components that they connect are looked at."""
    known = found.select(F.col("node").alias("n"), F.col("component").alias("c"))
    ends = links.select("a", "b").join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ends")
    roots = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    nodes = known.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    nodes = nodes.join(roots, F.col("c") == F.col("node"), "left")
    return nodes.select(F.col("n").alias("node"), F.coalesce("component", "c").alias("component"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the smaller end first, none from a node to itself."""
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.isnull("a") | F.isnull("b"))
    return ends.toDF("a", "b", "half").where("a < b AND NOT half").select("a", "b").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether every component is a star: no larger end has two edges or is a smaller end, too."""
    ends = edges.select("a", F.lit(0).alias("up")).union(edges.select("b", F.lit(1)))
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
    more = F.coalesce(F.sum(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("all") > F.col("up"))), 1)), F.lit(0))
    rows, unlike = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), more).first()
    return rows, unlike == 0
