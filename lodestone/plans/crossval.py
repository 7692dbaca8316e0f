"""Cross-validated models of text quality."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import crossval
from lodestone.plans.common import plan, read
from lodestone.plans.resampling import _u

_FOLDS, _REPEATS, _STEPS = 4, 2, 9


def _one_sql() -> str:
    """A constant and one feature: Newton's steps of two unknowns for each model."""
    out = [
        "d AS (SELECT doc_id, quality AS y, CASE WHEN doc_id % 7 <> 0 THEN ln(1 + n_chars) END AS x FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)",
        f"p AS MATERIALIZED (SELECT r, doc_id, y, x, (row_number() OVER (PARTITION BY r, y ORDER BY {_u("'31'", 'r', 'doc_id')}, doc_id) - 1) % {_FOLDS} AS own FROM d, range({_REPEATS}) AS t(r))",
        f"t AS MATERIALIZED (SELECT r, f, y, x FROM p, range({_FOLDS}) AS t(f) WHERE f <> own)", "med AS (SELECT r, f, median(x) AS med FROM t GROUP BY ALL)",
        "sc AS MATERIALIZED (SELECT r, f, med, avg(coalesce(x, med)) AS mu, stddev_pop(coalesce(x, med)) AS sd FROM t JOIN med USING (r, f) GROUP BY ALL)",
        "z AS MATERIALIZED (SELECT r, f, y, (coalesce(x, med) - mu) / sd AS z FROM t JOIN sc USING (r, f))", "b0 AS (SELECT DISTINCT r, f, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM sc)",
    ]
    for i in range(_STEPS):
        out += [
            f"e{i} AS (SELECT r, f, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS mu FROM z JOIN b{i} USING (r, f))",
            f"s{i} AS MATERIALIZED (SELECT r, f, a, b, sum(mu - y) AS g0, sum(z * (mu - y)) + b AS g1, sum(mu * (1 - mu)) AS h00, sum(z * mu * (1 - mu)) AS h01, sum(z * z * mu * (1 - mu)) + 1 AS h11 FROM e{i} GROUP BY r, f, a, b)",
            f"b{i + 1} AS (SELECT r, f, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{i})",
        ]
    return f"""WITH {', '.join(out)} SELECT doc_id, r::INT AS "repeat", own::INT AS fold, round(1 / (1 + exp(-(a + b * (coalesce(x, med) - mu) / sd))), 7) AS score FROM p JOIN sc ON sc.r = p.r AND sc.f = own JOIN b{_STEPS} m ON m.r = p.r AND m.f = own""".replace("SELECT doc_id, r::INT", "SELECT doc_id, p.r::INT")


@plan(_one_sql())
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of good quality by a text's length, which some texts lack, by the model that didn't see the text."""
    d, l = read(spark, sf_dir, "documents", "labels")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.log1p(F.col("n_chars").cast("double"))).alias("x")).join(l, "doc_id")
    scores, _ = crossval.cross_validated(rows, "doc_id", "quality", ["x"], _FOLDS, _REPEATS, 31)
    return scores.withColumn("score", F.round("score", 7))


@plan()
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several measures of a text, the at most two that each training part's lasso keeps: repeat, fold, feature, coefficient, c."""
    d, l = read(spark, sf_dir, "documents", "labels")
    words = F.size(F.split("text", r"\s+"))
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / F.greatest(F.length("text"), F.lit(1))
    measures = {"length": F.log1p(F.col("n_chars").cast("double")), "words": F.log1p(words), "digits": share("[^0-9]+"), "capitals": share("[^A-Z]+"), "stops": share("[^.]+"), "spaces": share(r"\S+")}
    rows = d.select("doc_id", *[e.alias(n) for n, e in measures.items()]).join(l, "doc_id")
    _, models = crossval.cross_validated(rows, "doc_id", "quality", list(measures), 3, 1, 32, most_features=2)
    kept = [(m // 3, m % 3, f, float(models.beta[m, j + 1]), float(models.c[m])) for m in range(len(models.beta)) for j, f in enumerate(models.features) if models.beta[m, j + 1]]
    return spark.createDataFrame(kept, "repeat int, fold int, feature string, coefficient double, c double")
