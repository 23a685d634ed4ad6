"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round links nodes to the smallest node in reach with joins and aggregates only, so a node with very many
neighbours is pre-aggregated before the shuffle and its joined rows are split by adaptive execution. Rounds grow with
the logarithm of the longest path; each is written to the shared work folder, so that its lineage ends there, in as
many files as its edges ask for and not one for each shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import few_files, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and two sums over hashes."""
    return tuple(edges.agg(
        F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16)), F.sum(F.shiftright(F.xxhash64("v", "u"), 16))).first())


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """One row ``(node, root)`` per node of ``edges`` (columns ``u``, ``v``); ``root`` is the smallest node it reaches.

    Loops and repeated edges are allowed; edges with a null end are ignored. No edges give no rows. ``at_most`` tells
    about how many edges there can be, if that is known; it only settles in how many files they are written first.
    """
    edges = edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct()
    edges = written(edges if at_most is None else few_files(edges, at_most), "edges")
    before = _state(edges)
    while True:
        edges = written(few_files(_small_star(_large_star(edges)).filter("u <> v").distinct(), before[0]), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    named = roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return few_files(named, before[0])
