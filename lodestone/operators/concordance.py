"""Kendall's tau-b by distributed inversion counting: n log n work, no pair is a row.

Rows become distinct (x, y) with their number.  A pair is discordant if x grows and y falls.  Ranges of the (x, y) order and ranges of the y order deal all pairs:
those that differ in both ranges are counted by the table of ranges, at most 4 ** RANGE_BITS numbers; those within a range of (x, y), and those
of one range of y in different ranges of (x, y), are counted in the range's task by merging.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.prefix import with_ranges


#: At most 2 ** RANGE_BITS ranges of either order.
RANGE_BITS = 11


def falling(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight products over pairs whose `first` grows and whose `second` falls (both strictly), by merging halves bit by bit."""
    if len(first) < 2:
        return 0
    x, y = np.unique(first, return_inverse=True)[1], np.unique(second, return_inverse=True)[1]
    order = np.argsort(-y, kind="stable")  # from the largest y; equal y are told apart below
    x, y, weight = x[order], y[order], weight[order].astype(object if float(weight.sum()) > 2**31 else np.int64)
    total = 0
    for bit in range(int(x.max()).bit_length()):
        # pairs that agree above this bit: the one with a 0 has the smaller x and, if it stands before, the larger y
        order = np.argsort(x >> (bit + 1), kind="stable")
        g, b, v, w = x[order] >> (bit + 1), (x[order] >> bit) & 1, y[order], weight[order]
        zeros = np.cumsum(np.where(b == 0, w, 0))
        start = np.concatenate([[True], g[1:] != g[:-1]])
        before_group = np.repeat((zeros - np.where(b == 0, w, 0))[start], np.diff(np.append(np.flatnonzero(start), len(g))))
        # zeros with a strictly larger y: those before the first row of this group and y
        run = start | np.concatenate([[True], v[1:] != v[:-1]])
        before_run = np.repeat((zeros - np.where(b == 0, w, 0))[run], np.diff(np.append(np.flatnonzero(run), len(g))))
        total += int(((before_run - before_group) * np.where(b == 1, w, 0)).sum())
    return total


def _counted(first: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [str(falling(pdf[first].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()))]})

    return run


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: tau_b, n, concordant, discordant, ties_x, ties_y (pairs tied in x, in y); tau_b is null where all pairs are tied in one.  Rows with a null are left out."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cells = with_ranges(rows.groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"], RANGE_BITS).withColumnRenamed("_range", "rx")
    ys = with_ranges(cells.select("y").distinct(), ["y"], RANGE_BITS).withColumnRenamed("_range", "ry")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    pairs = lambda c: F.coalesce(F.sum(big(c) * (big(c) - 1) / 2).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    # within a range of (x, y)
    within = cells.groupBy("rx").applyInPandas(_counted("x"), "d string")
    # in one range of y and different ranges of (x, y); equal y of one range of (x, y) are one row
    placed = cells.join(ys, "y").groupBy("ry", "rx", "y").agg(F.sum("n").alias("n"))
    beside = placed.groupBy("ry").applyInPandas(_counted("rx"), "d string")
    # in different ranges of both: rows of smaller rx and larger ry, by running sums over the table of ranges
    table = placed.groupBy("rx", "ry").agg(F.sum("n").alias("n"))
    columns = table.select("rx").distinct().crossJoin(F.broadcast(table.select("ry").distinct())).join(table, ["rx", "ry"], "left").select("rx", "ry", F.coalesce("n", F.lit(0)).alias("n"))
    before = columns.withColumn("left", F.sum("n").over(Window.partitionBy("ry").orderBy("rx").rowsBetween(Window.unboundedPreceding, -1)))
    above = before.withColumn("above", F.sum("left").over(Window.partitionBy("rx").orderBy("ry").rowsBetween(1, Window.unboundedFollowing)))
    across = above.select((big("n") * F.coalesce(F.col("above"), F.lit(0)).cast("decimal(38,0)")).cast("string").alias("d"))
    d = within.union(beside).union(across).agg(F.coalesce(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("discordant"))
    tx = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ties_x"))
    ty = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ties_y"))
    txy = cells.agg(pairs("n").alias("ties_both"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = tx.crossJoin(ty).crossJoin(txy).crossJoin(d)  # one row each
    whole = big("n") * (big("n") - 1) / 2
    one = one.withColumn("whole", whole.cast("decimal(38,0)")).withColumn("concordant", (F.col("whole") - F.col("ties_x") - F.col("ties_y") + F.col("ties_both") - F.col("discordant")).cast("decimal(38,0)"))
    double = lambda c: F.col(c).cast("double")
    below = F.sqrt((double("whole") - double("ties_x")) * (double("whole") - double("ties_y")))
    return one.select(F.try_divide(double("concordant") - double("discordant"), below).alias("tau_b"), "n", "concordant", "discordant", "ties_x", "ties_y")
