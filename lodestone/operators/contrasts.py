"""Contrasts of two groups, agreement of raters and precision of a ranking, from aggregates and rank windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.prefix import running, with_ranges


def welch_t(df: DataFrame, keys: list[str], value: str, group: Column) -> DataFrame:
    """keys, n1, n0, t, df: unequal-variance t of rows where group is true against the rest; nulls skipped, t null with under two in a group."""
    x = F.col(value)
    parts = {}
    for tag, test in (("1", group), ("0", ~group)):
        own = F.when(test, x)
        parts |= {f"n{tag}": F.count(own), f"m{tag}": F.avg(own), f"v{tag}": F.var_samp(own)}
    a = df.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    enough = (F.col("n1") > 1) & (F.col("n0") > 1) & (s1 + s0 > 0)
    t = F.when(enough, (F.col("m1") - F.col("m0")) / F.sqrt(s1 + s0))
    free = F.when(enough, F.pow(s1 + s0, 2) / (F.pow(s1, 2) / (F.col("n1") - 1) + F.pow(s0, 2) / (F.col("n0") - 1)))
    return a.select(*keys, "n1", "n0", t.alias("t"), free.alias("df"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: Column) -> DataFrame:
    """keys, n1, n0, u: U of the rows where group is true, ties at mid-ranks.

    Values are counted before they are ranked, so ties take one row a key and value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(group).alias("c1"), F.count_if(~group).alias("c0"))
    run = running(with_ranges(counts, [*keys, value]), F.col("c0"), [value], "_run", by=keys)
    ranked = run.withColumn("u", F.col("c1") * (F.col("_run") - F.col("c0") / 2.0))
    return ranked.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.sum("u").alias("u"))


def kendall_w(df: DataFrame, rater: str, item: str, rank: str) -> DataFrame:
    """One row: raters m, items n and Kendall's W of complete rankings, without a tie correction."""
    sums = df.groupBy(item).agg(F.sum(rank).alias("r"), F.count_distinct(rater).alias("m"))
    out = sums.agg(F.max("m").alias("m"), F.count("*").alias("n"), F.var_pop("r").alias("v"))
    w = F.when((F.col("n") > 1) & (F.col("m") > 0), 12 * F.col("v") / (F.pow("m", 2) * (F.pow("n", 2) - 1)))
    return out.select("m", "n", w.alias("w"))


def precision_at(df: DataFrame, score: str, positive: Column, ids: list[str], ks: list[int]) -> DataFrame:
    """k, hits, precision: share positive among the k best, ties by ids. Each k is a top-k of its own, which Spark merges from partitions."""
    out = None
    for k in ks:
        best = df.filter(F.col(score).isNotNull()).orderBy(F.desc(score), *ids).limit(k)
        one = best.agg(F.lit(k).alias("k"), F.count_if(positive).alias("hits"), (F.count_if(positive) / F.count("*")).alias("precision"))
        out = one if out is None else out.union(one)
    return out


def youden(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """keys, threshold, j: the largest sensitivity + specificity - 1 of `score >= threshold`, the smallest such threshold on ties."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    hits = running(with_ranges(counts, [*keys, score]), F.col("p"), [score], "_tp", backward=True, by=keys, total="_p")
    counts = running(hits, F.col("q"), [score], "_fp", backward=True, by=keys, total="_q")
    tp, fp, p, q = F.col("_tp"), F.col("_fp"), F.col("_p"), F.col("_q")
    # cross-multiplied, so that ties are exact
    scaled = counts.select(*keys, F.col(score).alias("threshold"), (tp * q - fp * p).alias("x"), (p * q).alias("pq"))
    best = scaled.filter("pq > 0").groupBy(*keys).agg(F.min_by(F.struct("threshold", "x", "pq"), F.struct(-F.col("x"), "threshold")).alias("b"))
    return best.select(*keys, "b.threshold", (F.col("b.x") / F.col("b.pq")).alias("j"))


def log_cpm(df: DataFrame, sample: str, feature: str, count: str) -> DataFrame:
    """sample, feature, log2 of counts a million plus one; samples without counts get null."""
    total = F.sum(count).over(Window.partitionBy(sample))
    return df.select(sample, feature, F.when(total > 0, F.log2(F.col(count) / total * 1e6 + 1)).alias("log_cpm"))


def best_probe(df: DataFrame, symbol: str, probe: str, value: str) -> DataFrame:
    """symbol, probe, mean: the probe of the highest mean per symbol, the smallest on ties."""
    means = df.groupBy(symbol, probe).agg(F.avg(value).alias("mean"))
    best = means.groupBy(symbol).agg(F.min_by(F.struct(probe, "mean"), F.struct(-F.col("mean"), probe)).alias("b"))
    return best.select(symbol, f"b.{probe}", "b.mean")
