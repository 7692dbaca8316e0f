"""Places: population near sites, and co-location."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks among which the cells of a join of places are dealt; places are few bytes and many pairs.
TASKS = 192


def near_any(points: DataFrame, key: str, sites: DataFrame, radius: float) -> DataFrame:
    """points (key, x, y, ..) with `near`: whether a site (x, y) lies within radius; sites are spread over the nine cells around them.  Points and sites of one place are one row first."""
    offsets = F.sequence(F.lit(-1), F.lit(1))
    s = sites.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct().withColumn("_cx", F.explode(F.transform(offsets, lambda o: F.floor(F.col("_x") / radius) + o)))
    s = s.withColumn("_cy", F.explode(F.transform(offsets, lambda o: F.floor(F.col("_y") / radius) + o))).repartition(TASKS, "_cx", "_cy")
    p = points.select("x", "y").distinct().withColumn("_cx", F.floor(F.col("x") / radius)).withColumn("_cy", F.floor(F.col("y") / radius)).repartition(TASKS, "_cx", "_cy")
    hits = p.join(s, ["_cx", "_cy"]).filter(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) <= radius * radius).select("x", "y").distinct()
    return points.join(hits.withColumn("_h", F.lit(True)), ["x", "y"], "left").withColumn("near", F.coalesce("_h", F.lit(False))).select(*points.columns, "near")


def within(points: DataFrame, population: str, sites: DataFrame, key: str, radius: float) -> DataFrame:
    """sites (key, x, y) -> key, n, population: how many points (x, y, population) lie within radius of a site, and their sum.

    Points of one place are one row first, and so are sites, so pairs are those of places.
    """
    around = F.sequence(F.lit(-1), F.lit(1))
    p = points.groupBy("x", "y").agg(F.count("*").alias("_n"), F.sum(population).alias("_s")).withColumn("_cx", F.floor(F.col("x") / radius)).withColumn("_cy", F.floor(F.col("y") / radius)).repartition(TASKS, "_cx", "_cy")
    u = sites.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct().withColumn("_cx", F.explode(F.transform(around, lambda o: F.floor(F.col("_x") / radius) + o)))
    u = u.withColumn("_cy", F.explode(F.transform(around, lambda o: F.floor(F.col("_y") / radius) + o))).repartition(TASKS, "_cx", "_cy")
    met = u.join(p, ["_cx", "_cy"]).filter(F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2) <= radius * radius)
    sums = met.groupBy(F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return sites.join(sums, ["x", "y"], "left").select(key, F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_s", F.lit(0.0)).alias("population"))


def reach(points: DataFrame, key: str, by: str, population: str, sites: DataFrame, radius: float) -> DataFrame:
    """For each area the population of its points, that within radius of a site, and the share."""
    near = near_any(points, key, sites, radius)
    covered = F.sum(F.when(F.col("near"), F.col(population)).otherwise(0.0))
    return near.groupBy(by).agg(F.sum(population).alias("population"), covered.alias("covered"), F.try_divide(covered, F.sum(population)).alias("share"))


def co_located(df: DataFrame, place: list[str], key: str, group: str) -> DataFrame:
    """For each key how many others stand at its place, and how many groups they are of; counted by place and group first."""
    cells_ = df.groupBy(*place, group).agg(F.count("*").alias("_n"))
    all_ = cells_.groupBy(*place).agg(F.sum("_n").alias("_all"), F.count("*").alias("groups"))
    return df.join(all_, place).select(key, (F.col("_all") - 1).alias("others"), "groups")
