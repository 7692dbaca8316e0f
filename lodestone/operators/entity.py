"""Entity resolution: blocks, similarity, components, constrained clusters."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lexicon import spelled
from lodestone.sources.shared import saved


def block_pairs(df: DataFrame, key: str, block: list[str]) -> DataFrame:
    """Pairs a < b of one block; blocks must be small (see the callers' filters)."""
    x, y = df.select(F.col(key).alias("a"), *block), df.select(F.col(key).alias("b"), *block)
    return x.join(y, block).filter("a < b").select("a", "b")


def anchor_edges(df: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Edges from the smallest id of equal rows to the others: a star, not all pairs."""
    low = df.groupBy(*same).agg(F.min(key).alias("a"))
    return df.join(low, same).filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any type that has an order -> node, component (its smallest node): minima spread along edges and labels jump to their label's label, until none falls.

    Labels only fall, so the rounds end; a long chain takes as many as the logarithm of its length, about.
    """
    both = saved(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), F.col("c").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = saved(lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        if labels.filter("component <> old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def ancestors(parents: DataFrame) -> DataFrame:
    """parents (node, parent) -> node, ancestor: a row for each path upwards, however long.

    Rounds double the paths: those of up to 2 ** k steps go on from the ends of those of just as many, so each is made once and the rounds are the logarithm of the
    longest.  A node that is its own ancestor is an error.
    """
    jump = saved(parents.filter("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("ancestor")), "paths")
    found = jump
    while True:
        own = found.filter("node = ancestor").limit(5).collect()
        if own:
            raise ValueError(f"nodes are their own ancestors: {sorted(r['node'] for r in own)}")
        ends = jump.select("node", F.col("ancestor").alias("_end"))
        on = lambda paths: ends.join(paths.select(F.col("node").alias("_end"), "ancestor"), "_end").select("node", "ancestor")  # noqa: B023, E731
        more, jump = saved(on(found), "paths"), saved(on(jump), "paths")
        if more.isEmpty():
            return found
        found = found.union(more)


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 of the sorted words: 200 x common subsequence / total length."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * _common_length(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best token-sort ratio among the shared words and the shared words with each side's rest."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    pairs = [(one, two)] + ([(both, one), (both, two)] if both else [])
    return max(200.0 * _common_length(p, q) / (len(p) + len(q)) if p or q else 100.0 for p, q in pairs)


def fuzzy_edges(df: DataFrame, key: str, name: str, block: list[str], least: int) -> DataFrame:
    """a < b, ratio: pairs of a block whose names, in lower case and with their words sorted, agree to `least` hundredths.

    Distinct names of a block meet by their rarest pairs of letters, not each with each; equal names of many rows are compared once.
    """
    rows = df.filter(F.col(name).isNotNull()).select(F.col(key).alias("_key"), F.array_join(F.array_sort(F.split(F.lower(name), " ")), " ").alias("_s"), F.struct(*block).alias("_block")).filter("_s <> ''")
    names = saved(rows.select("_s", "_block").distinct().withColumn("_n", F.monotonically_increasing_id()), "names")
    close = spelled(names.select(F.col("_n").alias("_q"), F.col("_s").alias("_qs"), "_block"), names.select(F.col("_n").alias("_e"), F.col("_s").alias("_es"), "_block"), least, ["_block"])
    named = rows.join(names, ["_s", "_block"]).select("_key", "_n")
    pairs = close.join(named.select(F.col("_key").alias("a"), F.col("_n").alias("_q")), "_q").join(named.select(F.col("_key").alias("b"), F.col("_n").alias("_e")), "_e")
    return pairs.filter("a < b").select("a", "b", "ratio")


def constrained_clusters(nodes: DataFrame, edges: DataFrame, single: str) -> DataFrame:
    """nodes (id, kind), edges (a, b, conf) -> id, cluster (its smallest id).

    Edges join clusters from the surest down (ties by a, then b) unless the joined one would hold two nodes of the `single` kind.  A round takes the edges that are
    the best of both their clusters: no better one could change either of these first, so each is decided as in the order of all.  Edges between clusters that may
    not join, or of one cluster, go.  Rounds end when no edge is left; as many are needed as the longest run of clusters each of which waits for the next.
    """
    clusters = saved(nodes.select("id", F.col("id").alias("cluster"), (F.col("kind") == single).cast("int").alias("n")), "clusters")
    links = saved(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "conf", "a", "b"), "links")
    while True:
        count = clusters.groupBy("cluster").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        of = lambda c: count.select(F.col("cluster").alias(c), F.col("n").alias(f"n{c}"))  # noqa: B023, E731
        open_ = links.filter("x <> y").join(of("x"), "x").join(of("y"), "y").filter("nx + ny <= 1")
        order = F.struct((-F.col("conf")).alias("c"), F.col("a"), F.col("b"))
        # of the edges between two clusters only the best matters
        open_ = saved(open_.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(order).alias("o")), "open")
        if open_.isEmpty():
            return clusters.select("id", "cluster")
        best = open_.select(F.explode(F.array("x", "y")).alias("cluster"), "o").groupBy("cluster").agg(F.min("o").alias("o"))
        # an edge that is the best of two clusters joins them, the larger to the smaller
        joined = open_.join(best.select(F.col("cluster").alias("x"), "o"), ["x", "o"]).join(best.select(F.col("cluster").alias("y"), "o"), ["y", "o"]).select("x", "y")
        move = saved(joined, "joined")
        to = lambda c: move.select(F.col("y").alias(c), F.col("x").alias("_to"))  # noqa: B023, E731
        clusters = saved(clusters.join(to("cluster"), "cluster", "left").select("id", F.coalesce("_to", "cluster").alias("cluster"), "n"), "clusters")
        links = open_.select("x", "y", (-F.col("o.c")).alias("conf"), "o.a", "o.b")
        for c in ("x", "y"):
            links = links.join(to(c), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        links = saved(links.select("x", "y", "conf", "a", "b"), "links")
