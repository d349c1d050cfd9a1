"""Connected components of a graph given by its edges, by alternating large and small stars.

Every node is linked to the smallest node it knows of, in turn among larger and smaller neighbours, until each component is a
star around its smallest node. No node's neighbours are ever gathered: a round is a pre-aggregated minimum and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, work_dir, written


def _star(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "a")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _star(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _star(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long, without null): root is the smallest node of its component.

    Repeated edges, either direction and loops are allowed; a node that only has a loop is its own root. No edges, no rows. The
    result is a table in `folder`, a work folder on shared storage; what the rounds leave there is removed as they end.
    """
    spark = edges.sparkSession
    folder = folder or work_dir(spark, "components")
    given = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/given")
    now, before, turn = given.where("a <> b"), None, 0
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    while (state := mark(now)) != before:
        before, turn = state, turn + 1
        now = written(_small(_large(now)), f"{folder}/edges-{turn}")
        remove(spark, f"{folder}/edges-{turn - 1}")
    # Stars: every larger node has its root by now; what is left are roots and nodes of loops.
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = given.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
    out = written(roots.unionByName(own.select("node", F.col("node").alias("root"))), f"{folder}/roots")
    remove(spark, f"{folder}/given")
    remove(spark, f"{folder}/edges-{turn}")
    return out
