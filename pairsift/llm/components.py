"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_folder, not_broadcast, shared_folder, written


def _stars(edges: DataFrame, mine: str) -> DataFrame:
    """Each edge with the least neighbour of its ``u`` (or ``u`` itself) as ``mine``.

    Least neighbours are partial sums first. The join then has one row a node on one side and narrow edges on the other;
    adaptive execution splits a hub's partition of those over several tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias(mine))
    return edges.join(not_broadcast(least), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that can be reached.

    Edges from a node to itself only add that node; repeated edges and either direction are fine. Nulls are ignored.
    The edges are computed once. Each round's are kept as a table, of which few tasks read many small files; a checkpoint
    would compute them twice and be read by as many tasks as there are partitions, all of which the driver keeps.
    """
    spark = edges.sparkSession
    known = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    given = written(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now, folder, before = given.filter("u <> v"), None, None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, last = mark, folder
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = _stars(both, "m").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _stars(large, "m").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        folder = shared_folder(spark)
        now = written(small.filter("u <> v").distinct(), folder)
        if last is not None:
            delete_folder(spark, last)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = given.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct()).unionByName(alone.join(nodes.select("node"), "node", "left_anti")).distinct()
