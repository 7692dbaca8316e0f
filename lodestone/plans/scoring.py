"""Scoring, from the flagship ranking to phenotypes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import scoring
from lodestone.operators.prefix import saved
from lodestone.operators.ranking import percentile_rank, percentile_ranks
from lodestone.plans.common import plan, read

_PCT = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER ()"
_AREAS = """SELECT n_nationkey, n_name, n_regionkey, round(avg(o_totalprice), 4) AS burden, count(DISTINCT o_orderkey) AS readiness,
round((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) * 100.0 / count(DISTINCT c_custkey), 6) AS capacity
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3"""


def areas(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Burden, readiness and capacity of each nation."""
    n, c, s, o = read(spark, sf_dir, "nation", "customer", "supplier", "orders")
    o = o if orders is None else orders
    suppliers = s.groupBy("s_nationkey").agg(F.count("*").alias("n_s"))
    # orders are summed by customer first, and only sums reach the nations
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("o_totalprice").alias("n_o"))
    j = c.join(per, c.c_custkey == per.o_custkey).groupBy("c_nationkey").agg(F.sum("total").alias("total"), F.sum("n_o").alias("readiness"), F.count("*").alias("n_c"))
    out = n.join(j, n.n_nationkey == j.c_nationkey).join(suppliers, n.n_nationkey == suppliers.s_nationkey, "left")
    return out.select(
        "n_nationkey", "n_name", "n_regionkey", F.round(F.col("total") / F.col("readiness"), 4).alias("burden"), "readiness",
        F.round(F.coalesce("n_s", F.lit(0)) * 100.0 / F.col("n_c"), 6).alias("capacity"),
    )


WEIGHTS = {"burden_p": 0.4, "desert": 0.4, "readiness_p": 0.2}


@plan(f"""WITH a AS ({_AREAS}), p AS (SELECT *, {_PCT.format(x="burden")} AS burden_p, {_PCT.format(x="capacity")} AS capacity_p, {_PCT.format(x="readiness")} AS readiness_p FROM a),
s AS (SELECT n_nationkey, n_name, round(0.4 * burden_p + 0.4 * (burden_p + 1 - capacity_p) / 2 + 0.2 * readiness_p, 9) AS score FROM p)
SELECT n_nationkey, n_name, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, n_nationkey)::INT AS place FROM s ORDER BY place LIMIT 10""")
def rank_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations should get a deployment first: top ten by a weighted composite."""
    a = percentile_ranks(saved(areas(spark, sf_dir), "areas"), {v: f"{v}_p" for v in ("burden", "capacity", "readiness")})
    a = a.withColumn("desert", scoring.mean_of([F.col("burden_p"), 1 - F.col("capacity_p")], strict=True))
    score = F.round(scoring.weighted_composite({k: F.col(k) for k in WEIGHTS}, WEIGHTS), 9)
    a = a.withColumn("score", score)
    out = a.orderBy(F.col("score").desc(), "n_nationkey").limit(10)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "n_nationkey"))
    return out.select("n_nationkey", "n_name", F.round("score", 6).alias("score"), place.alias("place"))


@plan(f"""WITH a AS ({_AREAS}), p AS (SELECT *, {_PCT.format(x="burden")} AS b, {_PCT.format(x="capacity")} AS c, {_PCT.format(x="readiness")} AS r FROM a) SELECT n_nationkey, round((b + (1 - c) + (1 - r)) / 3, 9) AS desert FROM p""")
def desert_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.desert(saved(areas(spark, sf_dir), "areas"), "burden", ["capacity", "readiness"]).select("n_nationkey", F.round("desert", 9).alias("desert"))


@plan("""WITH m AS (SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) >= 8 THEN avg(c_acctbal) END AS v FROM customer GROUP BY 1, 2), a AS (SELECT c_nationkey, avg(v) AS m, count(v) AS n FROM m GROUP BY 1)
SELECT c_nationkey, n AS n_members, round(CASE WHEN n >= 5 THEN m END, 6) AS complete, round(CASE WHEN n >= 1 THEN m END, 6) AS available FROM a""")
def set_burden_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    m = c.groupBy("c_nationkey", "c_mktsegment").agg(F.when(F.count("*") >= 8, F.avg("c_acctbal")).alias("v"))
    one = scoring.set_burden(m, ["c_nationkey"], "c_mktsegment", "v", 5, "complete").withColumnRenamed("burden", "complete")
    two = scoring.set_burden(m, ["c_nationkey"], "c_mktsegment", "v", 5, "available").select("c_nationkey", F.col("burden").alias("available"))
    return one.join(two, "c_nationkey").select("c_nationkey", "n_members", F.round("complete", 6).alias("complete"), F.round("available", 6).alias("available"))


_SETS = {"equal": (1.0, 1.0, 1.0), "burden_first": (3.0, 1.0, 1.0), "no_burden": (0.0, 1.0, 1.0)}


@plan(f"""WITH a AS ({_AREAS}), p AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 <> 0 THEN {_PCT.format(x="burden")} END AS b, {_PCT.format(x="capacity")} AS c, {_PCT.format(x="readiness")} AS r FROM a),
w AS (SELECT * FROM (VALUES ('equal', 1.0, 1.0, 1.0), ('burden_first', 3.0, 1.0, 1.0), ('no_burden', 0.0, 1.0, 1.0)) t(name, wb, wc, wr))
SELECT name, n_nationkey, round((coalesce(wb * b, 0) + wc * c + wr * r) / (CASE WHEN b IS NULL THEN 0 ELSE wb END + wc + wr), 9) AS score FROM p, w""")
def weight_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = percentile_ranks(saved(areas(spark, sf_dir), "areas"), {v: f"{v}_p" for v in ("burden", "capacity", "readiness")})
    values = {"b": F.when(F.col("n_nationkey") % 6 != 0, F.col("burden_p")), "c": F.col("capacity_p"), "r": F.col("readiness_p")}
    scores = [F.struct(F.lit(n).alias("name"), F.round(scoring.weighted_composite(values, dict(zip("bcr", w, strict=True))), 9).alias("score")) for n, w in _SETS.items()]
    return a.select("n_nationkey", F.explode(F.array(*scores)).alias("s")).select("s.name", "n_nationkey", "s.score")


@plan(f"""WITH a AS ({_AREAS}), m AS (SELECT avg(burden) AS mb, avg(capacity) AS mc FROM a WHERE n_nationkey < 20) SELECT n_nationkey, round(0.7 * (burden - mb), 6) AS c_burden, round(0.3 * (capacity - mc), 6) AS c_capacity FROM a, m""")
def contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.contributions(areas(spark, sf_dir), ["burden", "capacity"], {"burden": 0.7, "capacity": 0.3}, F.col("n_nationkey") < 20)
    return out.select("n_nationkey", F.round("c_burden", 6).alias("c_burden"), F.round("c_capacity", 6).alias("c_capacity"))


_CUT = "1996-12-31"


@plan(f"""WITH v AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '{_CUT}'), a AS (SELECT n_nationkey, round(avg(o_totalprice), 4) AS burden FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN v ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT c_nationkey, count(*) AS later FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '{_CUT}' GROUP BY 1)
SELECT n_nationkey, round({_PCT.format(x="burden")}, 9) AS score, coalesce(later, 0) AS later FROM a LEFT JOIN f ON c_nationkey = n_nationkey""")
def asof_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The burden's percentile as of a date, beside what came after it."""
    o, c = read(spark, sf_dir, "orders", "customer")
    then = percentile_rank(saved(areas(spark, sf_dir, scoring.as_of(o, "o_orderdate", _CUT)), "areas"), "burden", "score")
    later = o.filter(F.col("o_orderdate") > F.lit(_CUT).cast("timestamp_ntz")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("later"))
    return then.join(later, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.round("score", 9).alias("score"), F.coalesce("later", F.lit(0)).alias("later"))


PHENOTYPE = {
    "intercept": -1.5,
    "threshold": 0.0,
    "features": [
        {"feature_key": "balance", "transform": "log", "coefficient": 0.8, "center": 8.0, "scale": 1.5},
        {"feature_key": "segment", "transform": "binary", "coefficient": 1.2},
        {"feature_key": "nation", "transform": "identity", "coefficient": 0.05, "center": 12.0},
    ],
}
_FEATURES = "SELECT c_custkey, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS segment, c_nationkey, c_nationkey * 1.0 AS nation FROM customer"
_COLUMNS = {"balance": "balance", "segment": "segment", "nation": "nation"}


@plan(f"""WITH f AS ({_FEATURES}), l AS (SELECT c_custkey, -1.5 + coalesce(0.8 * ((CASE WHEN balance > 0 THEN ln(balance) END) - 8.0) / 1.5, 0) + 1.2 * segment + 0.05 * (nation - 12) AS lp FROM f)
SELECT c_custkey, round(lp, 6) AS lp, round(1 / (1 + exp(-lp)), 6) AS score FROM l""")
def phenotype_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.phenotype_score(_phenotype_features(spark, sf_dir), PHENOTYPE, _COLUMNS)
    return out.select("c_custkey", F.round("lp", 6).alias("lp"), F.round("score", 6).alias("score"))


def _phenotype_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", F.when(F.col("c_custkey") % 8 != 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("segment"),
        "c_nationkey", F.col("c_nationkey").cast("double").alias("nation"),
    )


@plan(f"""WITH f AS ({_FEATURES}), l AS (SELECT c_nationkey AS band, -1.5 + coalesce(0.8 * ((CASE WHEN balance > 0 THEN ln(balance) END) - 8.0) / 1.5, 0) + 1.2 * segment + 0.05 * (nation - 12) AS lp FROM f),
c AS (SELECT band, count(*) AS n, count(*) FILTER (lp > 0) AS p FROM l GROUP BY 1), s AS (SELECT *, p BETWEEN 1 AND 4 AS small FROM c), o AS (SELECT *, count(*) FILTER (small) OVER () AS ns, row_number() OVER (PARTITION BY small ORDER BY p, band) AS rn FROM s)
SELECT band, n, CASE WHEN NOT (small OR (ns = 1 AND rn = 1)) THEN p END AS n_positive, small OR (ns = 1 AND rn = 1) AS suppressed FROM o""")
def phenotype_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated query pack, run by spark.sql."""
    sql = scoring.phenotype_sql(PHENOTYPE, "{features}", "c_custkey", _COLUMNS, "c_nationkey", 4)
    return spark.sql(sql, features=_phenotype_features(spark, sf_dir))


_U = ["(('0x' || substr(md5('3:' || d || ':' || n_nationkey || ':%d'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656" % k for k in (1, 2)]


@plan(f"""WITH a AS ({_AREAS}), x AS (SELECT n_nationkey, d, burden + 5000.0 * sqrt(-2 * ln({_U[0]})) * cos(2 * pi() * ({_U[1]})) AS x FROM a, range(1, 201) AS t(d)),
r AS (SELECT n_nationkey, row_number() OVER (PARTITION BY d ORDER BY x DESC, n_nationkey) AS r FROM x) SELECT n_nationkey, quantile_cont(r, 0.025) AS rank_low, quantile_cont(r, 0.5) AS rank_median, quantile_cont(r, 0.975) AS rank_high FROM r GROUP BY 1""")
def mc_rank_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank_intervals(areas(spark, sf_dir), "n_nationkey", "burden", F.lit(5000.0), 200, 3)


@plan("""WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS v, stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer GROUP BY 1) SELECT round(sqrt(greatest(0.0, var_samp(v) - avg(se * se))), 6) AS tau FROM s""")
def between_state_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    s = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count("*"))).alias("se"))
    return s.agg(F.round(scoring.between_group_sd(F.col("v"), F.col("se")), 6).alias("tau"))
