"""Intervals of proportions: Jeffreys, Korn-Graubard with its reliability rule, Wilson on clustered records; rounding of published shares."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.beta import beta_point, student_point
from lodestone.functions.scalars import wilson


def jeffreys(df: DataFrame, hits: str, trials: str, level: float = 0.95) -> DataFrame:
    """df with low and high: quantiles of Beta(hits + 1/2, trials - hits + 1/2); 0 without hits, 1 without misses, null without trials."""
    k, n, tail = F.col(hits), F.col(trials), (1 - level) / 2
    ok = (n > 0) & k.between(0, n)
    a, b = F.when(ok, k + 0.5), F.when(ok, n - k + 0.5)
    out = df.withColumn("low", beta_point(F.lit(tail), a, b)).withColumn("high", beta_point(F.lit(1 - tail), a, b))
    return out.withColumn("low", F.when(ok & (k == 0), 0.0).otherwise(F.col("low"))).withColumn("high", F.when(ok & (k == n), 1.0).otherwise(F.col("high")))


def korn_graubard(df: DataFrame, p: str, se: str, n: str, design_df: str, level: float = 0.95) -> DataFrame:
    """df with kg_low, kg_high, n_eff and reliability: the exact interval at the effective size p (1 - p) / se ** 2 (n at most, and n without variance), times the square
    of the quotient of Student quantiles with n - 1 and the design's degrees of freedom; all null without an estimate or rows."""
    a = 1 - level
    P, N, D = F.col(p).cast("double"), F.col(n).cast("double"), F.col(design_df).cast("double")
    ok = P.isNotNull() & ~F.isnan(P) & (N > 0)
    variance = F.col(se) * F.col(se)
    size = F.when(ok, F.when((F.coalesce(variance, F.lit(0.0)) <= 0) | P.isin(0.0, 1.0), N).otherwise(F.least(N, P * (1 - P) / variance)))
    out = df.withColumn("n_eff", size).withColumn("_t1", student_point(1 - a / 2, F.when(N > 1, N - 1))).withColumn("_t2", student_point(1 - a / 2, F.when(D > 0, D)))
    out = out.withColumn("_m", F.col("n_eff") * F.coalesce(F.pow(F.col("_t1") / F.col("_t2"), F.lit(2)), F.lit(1.0))).withColumn("_x", P * F.col("_m"))
    out = out.withColumn("_l", beta_point(F.lit(a / 2), F.col("_x"), F.col("_m") - F.col("_x") + 1)).withColumn("_h", beta_point(F.lit(1 - a / 2), F.col("_x") + 1, F.col("_m") - F.col("_x")))
    out = out.withColumn("kg_low", F.when(F.col("_x") <= 0, 0.0).otherwise(F.col("_l"))).withColumn("kg_high", F.when(F.col("_x") >= F.col("_m"), 1.0).otherwise(F.col("_h")))
    return out.withColumn("reliability", reliability(P, F.col("kg_low"), F.col("kg_high"), F.col("n_eff"), D)).drop("_t1", "_t2", "_m", "_x", "_l", "_h")


def reliability(p: Column, low: Column, high: Column, n_eff: Column, design_df: Column) -> Column:
    """The published rule for showing a proportion."""
    width = high - low
    return (
        F.when(p.isNull() | F.isnan(p), "suppress: no estimate").when(n_eff.isNull() | (n_eff < 30), "suppress: effective sample size < 30").when(width >= 0.30, "suppress: Korn-Graubard CI width >= 0.30")
        .when((width > 0.05) & (p > 0) & (width / p > 1.30), "suppress: relative CI width > 130%").when(design_df < 8, "review: design degrees of freedom < 8").when(p.isin(0.0, 1.0), "review: estimate of 0 or 1").otherwise("reliable")
    )


def clustered_wilson(df: DataFrame, by: list[str], hit: Column, cluster: str) -> DataFrame:
    """by, n, hits, n_clusters, n_eff, low, high: Wilson's interval at Kish's effective number of clusters, so that one cluster's many rows count as one."""
    each = df.filter(hit.isNotNull() & F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.count("*").alias("_m"), F.sum(hit.cast("int")).alias("_k"))
    one = each.groupBy(*by).agg(F.sum("_m").alias("n"), F.sum("_k").alias("hits"), F.count("*").alias("n_clusters"), (F.pow(F.sum("_m"), F.lit(2)) / F.sum(F.col("_m") * F.col("_m"))).alias("n_eff"))
    low, high = wilson(F.col("hits") / F.col("n") * F.col("n_eff"), F.col("n_eff"))
    return one.withColumn("low", low).withColumn("high", high)


def rounded_share_sd(percent: Column, n: Column) -> Column:
    """Standard deviation in percentage points of a share of n that was published as a whole per cent: binomial variance and a twelfth."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100))
    return F.sqrt(F.try_divide(p * (1 - p), n) * 1e4 + 1 / 12)
