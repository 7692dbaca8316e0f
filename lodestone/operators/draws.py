"""Permutation nulls with fixed group sizes and bootstraps with multinomial weights, all draws in one pass.

Every random number is the md5 of seed, draw and key, so draws don't depend on partitioning and other engines can repeat them.  Rows times draws
are summed in each task before anything is shuffled; keys must tell rows apart.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.prefix import running, saved, with_ranges

#: Random numbers have so many bits: twelve hexadecimal digits.
BITS = 48
#: Rows that a task ranks at a border, about.
AT_BORDER = 4096
#: Tasks among which draws are dealt.
TASKS = 192


def uniform(seed: int, *parts: Column | str) -> Column:
    """An integer below 2 ** BITS: the first digits of md5('seed:part:..')."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, BITS // 4), 16, 10).cast("long")


def summary(nulls: DataFrame, observed: Column | str, expected: float = 0.0, slack: float = 1e-12) -> DataFrame:
    """nulls (t, and the observed value in every row) -> one row: observed, null_mean, null_low, null_high, p, p_centre, retained, draws.

    p is two-sided about `expected`, p_centre about the null's own mean; both count the observed value as one more draw.  retained is the share
    of the observed distance from `expected` that the null's mean keeps.  Null values of t are left out.
    """
    obs = F.col(observed) if isinstance(observed, str) else observed
    stats = nulls.filter("t IS NOT NULL").agg(F.avg("t").alias("c"), F.percentile("t", F.lit(0.025)).alias("low"), F.percentile("t", F.lit(0.975)).alias("high"), F.count("*").alias("draws"), F.max(obs).alias("o"))
    far = lambda at: (F.abs(F.col("t") - at) >= F.abs(F.col("o") - at) - slack).cast("int")
    counted = nulls.filter("t IS NOT NULL").select("t").crossJoin(F.broadcast(stats)).groupBy("o", "c", "low", "high", "draws").agg(F.sum(far(F.lit(expected))).alias("a"), F.sum(far(F.col("c"))).alias("b"))
    share = lambda n: (F.col(n) + 1) / (F.col("draws") + 1)
    return counted.select(
        F.col("o").alias("observed"), F.col("c").alias("null_mean"), F.col("low").alias("null_low"), F.col("high").alias("null_high"), share("a").alias("p"), share("b").alias("p_centre"),
        F.try_divide(F.col("c") - expected, F.col("o") - expected).alias("retained"), "draws",
    )


def permuted_gaps(df: DataFrame, value: str, case: Column, key: str, draws: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """draw, t (difference of the means of cases and others under that draw's labels), observed; rows without a value or label are left out.

    A draw deals exactly as many cases as there are, in each stratum: to the rows with the smallest random numbers.  Which these are is found without
    sorting the rows: counts and sums by classes of the number tell in which class the border lies, and only the rows of border classes, about
    AT_BORDER of each draw and stratum, are ranked.
    """
    strata = strata or []
    rows = df.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"), case.alias("_case")).filter("_v IS NOT NULL AND _case IS NOT NULL")
    by = [f"_s{i}" for i in range(len(strata))]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if("_case").alias("_n1"))
    whole = rows.agg(F.count("*").alias("n"), F.count_if("_case").alias("n1"), F.sum("_v").alias("s"), F.sum(F.when(F.col("_case"), F.col("_v"))).alias("s1"))
    n = rows.count()
    shift = BITS - max(4, min(20, (n // AT_BORDER).bit_length()))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", uniform(seed, "draw", "_key")).withColumn("_class", F.shiftright("_u", shift))
    classes = drawn.groupBy("draw", *by, "_class").agg(F.count("*").alias("_c"), F.sum("_v").alias("_t"))
    w = Window.partitionBy("draw", *by).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    sized = classes.join(sizes, by) if by else classes.crossJoin(F.broadcast(sizes))
    sized = sized.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    below = sized.filter(F.col("_before") + F.col("_c") <= F.col("_n1")).groupBy("draw").agg(F.sum("_t").alias("_low"))
    border = sized.filter((F.col("_before") < F.col("_n1")) & (F.col("_before") + F.col("_c") > F.col("_n1"))).select("draw", *by, "_class", (F.col("_n1") - F.col("_before")).alias("_take"))
    at = drawn.join(border, ["draw", *by, "_class"]).withColumn("_rank", F.row_number().over(Window.partitionBy("draw", *by).orderBy("_u", "_key")))
    at = at.filter("_rank <= _take").groupBy("draw").agg(F.sum("_v").alias("_edge"))
    every = df.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    sums = every.join(below, "draw", "left").join(at, "draw", "left").select("draw", (F.coalesce("_low", F.lit(0.0)) + F.coalesce("_edge", F.lit(0.0))).alias("c")).crossJoin(F.broadcast(whole))
    gap = lambda c: F.try_divide(c, F.col("n1")) - F.try_divide(F.col("s") - c, F.col("n") - F.col("n1"))
    return sums.select("draw", gap(F.col("c")).alias("t"), gap(F.col("s1")).alias("observed"))


def permutation_null(df: DataFrame, value: str, case: Column, key: str, draws: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """summary() of permuted_gaps()."""
    return summary(permuted_gaps(df, value, case, key, draws, seed, strata), "observed")


def cluster_weights(clusters: DataFrame, cluster: str, draws: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """clusters (strata, cluster; each once) -> strata, cluster, draw, weight: how often a draw took the cluster; 0 isn't a row.

    A draw takes, in each stratum, as many clusters as there are, with replacement: the j-th takes the one whose number is the j-th random number
    modulo how many there are.  Numbers come from ranges of the clusters' order, so no task holds them all.
    """
    by = strata or []
    order = with_ranges(clusters.select(*by, cluster), [*by, cluster])
    numbered = running(order, F.lit(1), [cluster], "_i", by=by, total="_k").select(*by, cluster, (F.col("_i") - 1).alias("_i"), "_k")
    # few clusters are numbered in one task: draws are made where the numbers were dealt anew
    numbered = saved(numbered, "clusters")
    taken = numbered.repartition(TASKS, *by, cluster).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*by, "draw", F.pmod(uniform(seed, "draw", *by, "_i"), F.col("_k")).alias("_i"))
    return taken.repartition(TASKS, *by, "draw", "_i").groupBy(*by, "draw", "_i").agg(F.count("*").alias("weight")).join(numbered, [*by, "_i"]).select(*by, cluster, "draw", "weight")


def interval(drawn: DataFrame, level: float = 0.95) -> DataFrame:
    """drawn (t) -> low, high, draws: the percentile interval of the values that there are."""
    tail = (1 - level) / 2
    return drawn.agg(F.percentile("t", F.lit(tail)).alias("low"), F.percentile("t", F.lit(1 - tail)).alias("high"), F.count("t").alias("draws"))


def bootstrap_means(df: DataFrame, value: str, cluster: str, draws: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """draw, t: the mean of the rows of the clusters that a draw took; a cluster that is its row's key makes it the plain bootstrap.  Null values, clusters and strata are left out."""
    by = strata or []
    ok = F.col(value).isNotNull() & F.col(cluster).isNotNull()
    for s in by:
        ok = ok & F.col(s).isNotNull()
    totals = df.filter(ok).groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count("*").alias("_n"))
    weighted = cluster_weights(totals, cluster, draws, seed, by).join(totals, [*by, cluster])
    return weighted.groupBy("draw").agg((F.sum(F.col("weight") * F.col("_s")) / F.sum(F.col("weight") * F.col("_n"))).alias("t"))


def bootstrap_spearman(df: DataFrame, x: str, y: str, cluster: str, draws: int, seed: int) -> DataFrame:
    """draw, t: Spearman's correlation over the rows of the clusters that a draw took, each as often; ties share mid-ranks; null where a side is constant."""
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(cluster).alias("_c")).filter("_x IS NOT NULL AND _y IS NOT NULL AND _c IS NOT NULL")
    cells = rows.groupBy("_c", "_x", "_y").agg(F.count("*").alias("_n"))
    weights = cluster_weights(cells.select("_c").distinct(), "_c", draws, seed)
    drawn = cells.join(weights, "_c").groupBy("draw", "_x", "_y").agg(F.sum(F.col("_n") * F.col("weight")).alias("_w"))

    def ranks(v: str, out: str) -> DataFrame:
        values = drawn.groupBy("draw", v).agg(F.sum("_w").alias("_w"))
        run = running(with_ranges(values, ["draw", v]), F.col("_w"), [v], "_run", by=["draw"])
        return run.select("draw", v, (F.col("_run") - (F.col("_w") - 1) / 2).alias(out))

    r = drawn.join(ranks("_x", "a"), ["draw", "_x"]).join(ranks("_y", "b"), ["draw", "_y"])
    s = lambda e: F.sum(F.col("_w") * e)
    m = r.groupBy("draw").agg(F.sum("_w").alias("n"), s(F.col("a")).alias("sa"), s(F.col("b")).alias("sb"), s(F.col("a") * F.col("a")).alias("saa"), s(F.col("b") * F.col("b")).alias("sbb"), s(F.col("a") * F.col("b")).alias("sab"))
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return m.select("draw", F.when((va > 0) & (vb > 0), (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb)).alias("t"))
