"""Composite scores with uncertainty, dated views and phenotype scores."""
from __future__ import annotations

import json
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import expit
from lodestone.operators.draws import BITS, uniform
from lodestone.operators.ranking import percentile_ranks


def mean_of(terms: list[Column], strict: bool) -> Column:
    """Mean of terms: null if one is missing (strict), else over those that are there."""
    n = reduce(lambda a, b: a + b, [t.isNotNull().cast("int") for t in terms])
    total = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])
    return F.when(n == len(terms), total / len(terms)) if strict else F.try_divide(total, n)


def weighted_composite(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the components that are there; a missing one drops its weight; null if all weight is gone."""
    w = reduce(lambda a, b: a + b, [F.when(values[k].isNotNull(), F.lit(float(weights[k]))).otherwise(0.0) for k in values])
    s = reduce(lambda a, b: a + b, [F.coalesce(values[k] * float(weights[k]), F.lit(0.0)) for k in values])
    return F.try_divide(s, F.nullif(w, F.lit(0.0)))


def set_burden(df: DataFrame, by: list[str], member: str, value: str, defined: int, rule: str) -> DataFrame:
    """Mean over a set's members: 'complete' needs all that are defined, 'available' any."""
    if rule not in ("complete", "available"):
        raise ValueError(rule)
    a = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.countDistinct(F.when(F.col(value).isNotNull(), F.col(member))).alias("n_members"))
    need = defined if rule == "complete" else 1
    return a.select(*by, "n_members", F.when(F.col("n_members") >= need, F.col("_m")).alias("burden"))


def contributions(df: DataFrame, values: list[str], weights: dict[str, float], eligible: Column) -> DataFrame:
    """w (x - mean over eligible rows) of each component, as columns c_<name>."""
    means = df.filter(eligible).agg(*[F.avg(v).alias(f"_m_{v}") for v in values])
    out = df.crossJoin(F.broadcast(means))
    for v in values:
        out = out.withColumn(f"c_{v}", float(weights[v]) * (F.col(v) - F.col(f"_m_{v}")))
    return out.drop(*[f"_m_{v}" for v in values])


def as_of(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Rows dated on or before the cutoff; undated rows are out."""
    return df.filter(F.col(date) <= F.lit(cutoff).cast(df.schema[date].dataType))


def rank_intervals(df: DataFrame, key: str, score: str, sd: Column, draws: int, seed: int) -> DataFrame:
    """Rank quantiles of each key over draws of score + sd x normal noise, the noise from the md5 of seed, draw and key.

    df holds one row for each ranked key (areas, not records); rows grow by `draws`.
    """
    u = lambda k: (uniform(seed, "draw", key, F.lit(k)) + 0.5) / float(1 << BITS)
    noise = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * pi * u(2))
    rows = df.select(key, F.col(score).alias("_s"), sd.alias("_sd"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    rows = rows.withColumn("_x", F.col("_s") + F.col("_sd") * noise)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy(F.col("_x").desc_nulls_last(), key)))
    q = ranked.groupBy(key).agg(F.percentile("_r", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"))
    return q.select(key, *[F.col("_q")[i].alias(n) for i, n in enumerate(("rank_low", "rank_median", "rank_high"))])


def between_group_sd(value: Column, se: Column) -> Column:
    """Method of moments: root of sample variance less mean squared error, 0 where that is negative."""
    return F.sqrt(F.greatest(F.lit(0.0), F.var_samp(value) - F.avg(se * se)))


#: Transforms of a phenotype's features, as SQL on {x}.
TRANSFORMS = {
    "identity": "{x}",
    "log": "CASE WHEN {x} > 0 THEN ln({x}) END",
    "binary": "CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0 ELSE 0.0 END",
}


def feature_sql(feature: dict, column: str) -> str:
    """One feature's term: coefficient x (transform - centre) / scale; a missing value stands at the centre and adds nothing."""
    t = TRANSFORMS[feature["transform"]].format(x=column)
    return f"coalesce({float(feature['coefficient'])!r} * (({t}) - {float(feature.get('center', 0.0))!r}) / {float(feature.get('scale', 1.0))!r}, 0.0)"


def phenotype_score(df: DataFrame, phenotype: dict, columns: dict[str, str]) -> DataFrame:
    """Adds lp and score (logistic of lp) from the phenotype's features; columns maps a feature's key to a column."""
    terms = " + ".join(feature_sql(f, columns[f["feature_key"]]) for f in phenotype["features"])
    return df.withColumn("lp", F.expr(f"{float(phenotype['intercept'])!r} + {terms}")).withColumn("score", expit(F.col("lp")))


def phenotype_sql(phenotype: dict, table: str, key: str, columns: dict[str, str], band: str, smallest: int) -> str:
    """A query pack as SQL text: a CTE of terms, the linear predictor, counts by band, small cells and one more where it could be worked out."""
    terms = ",\n  ".join(f"{feature_sql(f, columns[f['feature_key']])} AS t{i}" for i, f in enumerate(phenotype["features"]))
    total = " + ".join([repr(float(phenotype["intercept"])), *[f"t{i}" for i in range(len(phenotype["features"]))]])
    return f"""WITH terms AS (SELECT {key}, {band} AS band, {terms} FROM {table}),
scored AS (SELECT {key}, band, {total} AS lp FROM terms),
counts AS (SELECT band, count(*) AS n, sum(CASE WHEN lp > {float(phenotype["threshold"])!r} THEN 1 ELSE 0 END) AS n_positive FROM scored GROUP BY band),
flagged AS (SELECT band, n, n_positive, n_positive BETWEEN 1 AND {smallest} AS small FROM counts),
ordered AS (SELECT band, n, n_positive, small, sum(CASE WHEN small THEN 1 ELSE 0 END) OVER () AS n_small, row_number() OVER (PARTITION BY small ORDER BY n_positive, band) AS rn FROM flagged)
SELECT band, n, CASE WHEN small OR (n_small = 1 AND rn = 1) THEN NULL ELSE n_positive END AS n_positive, small OR (n_small = 1 AND rn = 1) AS suppressed FROM ordered"""


def load_phenotype(text: str) -> dict:
    """A phenotype from JSON, with the fields that scoring needs."""
    got = json.loads(text)
    for name in ("intercept", "threshold", "features"):
        if name not in got:
            raise ValueError(f"phenotype lacks {name}")
    for f in got["features"]:
        if f.get("transform") not in TRANSFORMS:
            raise ValueError(f"unknown transform {f.get('transform')!r}")
    return got


def desert(df: DataFrame, burden: str, access: list[str], by: list[str] | None = None) -> DataFrame:
    """desert: mean of the burden's percentile and of 1 - the percentile of each access measure; null if one is missing."""
    out = percentile_ranks(df, {c: f"_p{i}" for i, c in enumerate([burden, *access])}, by)
    terms = [F.col("_p0"), *[1 - F.col(f"_p{i}") for i in range(1, len(access) + 1)]]
    return out.withColumn("desert", mean_of(terms, strict=True)).drop(*[f"_p{i}" for i in range(len(access) + 1)])
