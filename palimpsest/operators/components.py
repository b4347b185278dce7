"""Connected components of an edge table, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.staging import dropped, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of edges (a, b): root is the least vertex that can be reached.

    Each round, a vertex points to the least of itself and its neighbours, pointers are followed to
    their ends, and the edges between different ends are the next round's. Ends are never neighbours,
    so at most half of the vertices are left each time and the rows of all rounds together stay
    linear. Joins are on vertices and shuffle both sides, so that Spark can split a vertex with very
    many edges. Each step is a table in the shared folder, so lineage doesn't grow and a lost
    executor costs one step.
    """
    labels, left = None, edges.select("a", "b")
    while True:
        both = staged(left.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
        if labels is not None and both.isEmpty():
            dropped(both)
            return labels
        firsts = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "ends")
        ends = _ends(firsts)
        old, labels = labels, ends if labels is None else staged(_followed(labels, ends), "labels")
        to_a, to_b = (ends.select(F.col("id").alias(c), F.col("root").alias(f"end_{c}")) for c in "ab")
        apart = both.where("a < b").join(to_a, "a").join(to_b, "b").where("end_a <> end_b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b"))
        left = staged(apart.distinct(), "apart")
        dropped(both, *([old] if old is not None else []))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (id, root) of a graph's components after edges (a, b) are added; only the ends of edges are worked on."""
    to_a, to_b = (labels.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    between = edges.select("a", "b").join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(between)
    made = staged(_followed(labels, new).union(new.join(labels, "id", "left_anti").select("id", "root")), "labels")
    dropped(new)
    return made


def _followed(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """Labels whose roots are replaced by their own ends, where they have any."""
    return labels.join(ends.select(F.col("id").alias("root"), F.col("root").alias("end")), "root", "left").select("id", F.coalesce("end", "root").alias("root"))


def _ends(pointers: DataFrame) -> DataFrame:
    """Pointers (id, root) followed until they end; their reach doubles each time. The given table is dropped."""
    while True:
        further = _followed(pointers.select("id", "root"), pointers).withColumnRenamed("root", "end")
        new = staged(pointers.select("id", "root").join(further, "id").select("id", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "ends")
        dropped(pointers)
        pointers = new
        if new.where("moved").isEmpty():
            out = new.select("id", "root")
            out.staged_path = new.staged_path
            return out
