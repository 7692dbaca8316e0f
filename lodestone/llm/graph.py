"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): long ids, any direction, repeats and self-loops allowed -> (node, component), component = smallest id reachable.

    Only nodes with an edge to another node occur; edges with a null end say nothing and are left
    out.  Minima are written as tables of their own: a hub with very many edges is then grouped by
    a partial minimum or met in a plain join of two tables, which Spark splits.  Each step moves
    edges to smaller ends until none moves, so the rounds end; nothing is collected but a count and
    a checksum, and tables of past rounds are deleted.
    """
    tables = scratch.Tables()
    edges = tables.table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = tables.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = tables.table(both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct(), "large")
        small_low = tables.table(large.groupBy("b").agg(F.min("a").alias("m")), "low")
        small = large.join(small_low, "b")
        step = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        after = tables.table(step, "edges")
        tables.drop(edges, low, large, small_low)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
