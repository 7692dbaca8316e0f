"""Survey estimates, adjusted p-values, rank statistics and resampling, as aggregates and windows."""
from __future__ import annotations

from math import exp, lgamma

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.prefix import running, saved, with_ranges
from lodestone.operators.ranking import mid_rank


def taylor_mean(df: DataFrame, y: str, w: str, stratum: str, psu: str, domain: Column | None = None) -> DataFrame:
    """Design-based mean: estimate, se, df (PSUs less strata).

    Rows out of the domain stay with a score of zero, so that the whole design counts;
    a stratum with one PSU adds nothing.
    """
    d = F.coalesce(domain, F.lit(False)).cast("double") if domain is not None else F.lit(1.0)
    rows = df.select(stratum, psu, (F.col(w) * d).alias("_w"), (F.col(w) * d * F.col(y)).alias("_wy"))
    cells = rows.groupBy(stratum, psu).agg(F.sum("_w").alias("_w"), F.sum("_wy").alias("_wy"))
    total = cells.agg(F.sum("_w").alias("_tw"), F.sum("_wy").alias("_ty"))
    z = cells.crossJoin(F.broadcast(total)).withColumn("_z", (F.col("_wy") - F.try_divide("_ty", "_tw") * F.col("_w")) / F.col("_tw"))
    h = z.groupBy(stratum).agg(F.count("*").alias("n"), F.var_samp("_z").alias("v"), F.max("_ty").alias("Y"), F.max("_tw").alias("W"))
    var = F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("v")).otherwise(0.0))
    return h.agg(F.try_divide(F.max("Y"), F.max("W")).alias("estimate"), F.sqrt(var).alias("se"), (F.sum("n") - F.count("*")).alias("df"))


def standardized_rate(df: DataFrame, by: list[str], cell: str, y: str, w: str, standard: DataFrame, share: str) -> DataFrame:
    """Weighted mean by cell, then averaged with the standard's shares over the cells that are there."""
    cells = df.groupBy(*by, cell).agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_m"))
    return cells.join(standard, cell).groupBy(*by).agg((F.sum(F.col("_m") * F.col(share)) / F.sum(share)).alias("rate"))


def _numbered(df: DataFrame, p: str, key: str) -> DataFrame:
    """The rows with a p-value, in ranges, with _i (place from the smallest) and _n (how many)."""
    return running(with_ranges(df.filter(F.col(p).isNotNull()), [p, key]), F.lit(1), [p, key], "_i", total="_n")


def _with_nulls(adjusted: DataFrame, df: DataFrame, p: str, out: str) -> DataFrame:
    nulls = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return adjusted.withColumn(out, F.least(F.lit(1.0), F.col(out))).select(*df.columns, out).unionByName(nulls)


def bh_adjust(df: DataFrame, p: str, key: str, out: str) -> DataFrame:
    """Step-up adjusted p-values; nulls stay null and don't count.  key tells rows apart."""
    up = running(_numbered(df, p, key), F.col(p) * F.col("_n") / F.col("_i"), [p, key], out, "min", backward=True)
    return _with_nulls(up, df, p, out)


def holm_adjust(df: DataFrame, p: str, key: str, out: str) -> DataFrame:
    """Step-down adjusted p-values; nulls stay null and don't count.  key tells rows apart."""
    down = running(_numbered(df, p, key), F.col(p) * (F.col("_n") - F.col("_i") + 1), [p, key], out, "max")
    return _with_nulls(down, df, p, out)


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the curve from mid-ranks; null without both classes."""
    by = by or []
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*by, score).agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    run = running(with_ranges(counts, [*by, score]), F.col("_n"), [score], "_run", by=by)
    n1, n0 = F.coalesce(F.sum("_n1"), F.lit(0)), F.coalesce(F.sum("_n0"), F.lit(0))
    area = F.try_divide(F.sum(F.col("_n1") * (F.col("_run") - (F.col("_n") - 1) / 2)) - n1 * (n1 + 1) / 2, n1 * n0)
    return run.groupBy(*by).agg(area.alias("auroc"), n1.alias("n1"), n0.alias("n0"))


def sens_at_spec(df: DataFrame, score: str, label: str, spec: float) -> DataFrame:
    """Share of cases above the ceil(spec n)-th smallest control score."""
    counts = df.filter((F.col(label) == 0) & F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"))
    run = running(with_ranges(counts, [score]), F.col("_n"), [score], "_run", total="_all")
    cut = run.filter(F.col("_run") >= F.ceil(F.col("_all") * spec)).agg(F.min(score).alias("threshold"))
    return df.filter(F.col(label) == 1).crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("sensitivity"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = saved(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_a"), F.col(y).alias("_b")), "pairs")
    return mid_rank(mid_rank(both, "_a", "_x"), "_b", "_y").agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def hedges_g(df: DataFrame, value: str, label: str) -> DataFrame:
    """Standardised difference of cases and controls with the small-sample factor."""
    one, zero = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    a = df.agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), F.count(one).alias("n1"), F.count(zero).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    factor = 1 - 3 / (4 * (F.col("n1") + F.col("n0")) - 9)
    return a.select(((F.col("m1") - F.col("m0")) / pooled * factor).alias("g"), "n1", "n0")


def gower_to_centroid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over available columns of |x - mean| / (99th - 1st percentile), at most 1 each; columns without range are left out."""
    stats = df.agg(*[s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), (F.percentile(c, F.lit(0.99)) - F.percentile(c, F.lit(0.01))).alias(f"_r_{c}"))])
    j = df.crossJoin(F.broadcast(stats))
    parts = [F.when(F.col(f"_r_{c}") > 0, F.least(F.lit(1.0), F.abs(F.col(c) - F.col(f"_m_{c}")) / F.col(f"_r_{c}"))) for c in columns]
    total, n = sum(F.coalesce(p, F.lit(0.0)) for p in parts), sum(p.isNotNull().cast("int") for p in parts)
    return j.withColumn("gower", F.try_divide(total, n)).drop(*[f"{s}{c}" for c in columns for s in ("_m_", "_r_")])


def hypergeometric_p(k: int, population: int, marked: int, drawn: int) -> float:
    """Chance of k or more marked ones among those drawn."""
    c = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    return min(1.0, sum(exp(c(marked, i) + c(population - marked, drawn - i) - c(population, drawn)) for i in range(k, min(marked, drawn) + 1) if drawn - i <= population - marked))


def over_representation(items: DataFrame, library: DataFrame, item: str, term: str) -> DataFrame:
    """Counts for each term of the library: hits, size (in the background), drawn, background; fold.  The background is the library's items."""
    background = library.select(item).distinct()
    drawn = items.select(item).distinct().join(background, item, "left_semi")
    sizes = F.broadcast(background.agg(F.count("*").alias("background")).crossJoin(drawn.agg(F.count("*").alias("drawn"))))
    flagged = library.select(item, term).distinct().join(drawn.withColumn("_hit", F.lit(1)), item, "left")
    counts = flagged.groupBy(term).agg(F.count("_hit").alias("hits"), F.count("*").alias("size")).crossJoin(sizes)
    return counts.withColumn("fold", F.try_divide(F.col("hits") * F.col("background"), F.col("size") * F.col("drawn")))
