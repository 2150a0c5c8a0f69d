"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm._frames import forget, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round points every node to its smallest neighbour, jumps once, and keeps
    the distinct links between the nodes pointed to, so a component's links at
    least halve and rounds grow as the logarithm of its size. All joins carry ids
    alone; each round's tables are written, so nothing is recomputed. Links with a
    null end or equal ends count for nothing.
    """
    edges = materialize(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    roots = None
    while roots is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        jump = near.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = materialize(near.join(jump, "to").select("a", F.col("next").alias("to")))
        ends = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        linked = edges.join(step, "a").join(ends, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b"))
        fresh = materialize(linked.filter(F.col("a") != F.col("b")).distinct())
        forget(edges)
        edges = fresh
        if roots is None:  # every node has a neighbour
            roots = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
            roots._pointweave_path = step._pointweave_path
            continue
        moved = roots.join(step.select(F.col("a").alias("root"), "to"), "root", "left")
        moved = materialize(moved.select("node", F.coalesce("to", "root").alias("root")))
        forget(step)
        forget(roots)
        roots = moved
    forget(edges)
    return roots


def merged_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` of some links after ``links`` have been added; only what these join is worked on."""
    if links.isEmpty():
        return roots
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected_components(ends)
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    out = materialize(moved.union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")))
    forget(joined)
    return out
