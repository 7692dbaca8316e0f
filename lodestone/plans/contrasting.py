"""Contrasts, agreement and ranking precision on the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import contrasts
from lodestone.plans.common import plan, read


@plan("""WITH a AS (SELECT l_shipdate, l_returnflag AS flag, l_linestatus = 'F' AS g, l_quantity AS x FROM lineitem), s AS (SELECT flag, count(x) FILTER (g) AS n1, count(x) FILTER (NOT g) AS n0,
avg(x) FILTER (g) AS m1, avg(x) FILTER (NOT g) AS m0, var_samp(x) FILTER (g) / count(x) FILTER (g) AS s1, var_samp(x) FILTER (NOT g) / count(x) FILTER (NOT g) AS s0 FROM a GROUP BY 1)
SELECT flag, n1, n0, round((m1 - m0) / sqrt(s1 + s0), 6) AS t, round(pow(s1 + s0, 2) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)), 3) AS df FROM s""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_returnflag").alias("flag"), "l_linestatus", "l_quantity")
    out = contrasts.welch_t(rows, ["flag"], "l_quantity", F.col("l_linestatus") == "F")
    return out.select("flag", "n1", "n0", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@plan("""WITH r AS (SELECT l_returnflag AS flag, l_linestatus = 'F' AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem)
SELECT flag, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0, sum(r) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0 AS u FROM r GROUP BY 1""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return contrasts.mann_whitney(l.select(F.col("l_returnflag").alias("flag"), "l_linestatus", "l_quantity"), ["flag"], "l_quantity", F.col("l_linestatus") == "F")


_RANKS = "SELECT o_orderpriority AS rater, c_nationkey AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, c_nationkey) AS r FROM {o} JOIN {c} ON o_custkey = c_custkey GROUP BY 1, 2"


@plan(f"""WITH k AS ({_RANKS.format(o="orders", c="customer")}), s AS (SELECT item, sum(r)::DOUBLE AS r, count(DISTINCT rater) AS m FROM k GROUP BY 1), a AS (SELECT max(m) AS m, count(*) AS n, var_pop(r) AS v FROM s)
SELECT m, n, round(12 * v / (m * m * (n * n - 1)), 8) AS w FROM a""")
def kendall_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders", "customer")
    out = contrasts.kendall_w(spark.sql(_RANKS, o=o, c=c), "rater", "item", "r")
    return out.select("m", "n", F.round("w", 8).alias("w"))


@plan("""WITH r AS (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL)
SELECT k, count(*) FILTER (quality = 1) AS hits, count(*) FILTER (quality = 1) / count(*) AS precision FROM r JOIN (SELECT unnest([10, 50, 100])::INT AS k) ON r <= k GROUP BY 1""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents", "labels")
    rows = d.select("doc_id", "n_chars").join(l, "doc_id").select("doc_id", "n_chars", "quality")
    return contrasts.precision_at(rows, "n_chars", F.col("quality") == 1, ["doc_id"], [10, 50, 100])


@plan("""WITH x AS (SELECT n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM x GROUP BY 1),
t AS (SELECT s, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS p, sum(q) OVER () AS q FROM c WINDOW w AS (ORDER BY s DESC))
SELECT s AS threshold, round((tp * q - fp * p)::DOUBLE / (p * q), 8) AS j FROM t ORDER BY tp * q - fp * p DESC, s LIMIT 1""")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents", "labels")
    rows = d.select("doc_id", "n_chars").join(l, "doc_id")
    return contrasts.youden(rows, [], "n_chars", F.col("quality") == 1).select("threshold", F.round("j", 8).alias("j"))


@plan("""WITH c AS (SELECT l_suppkey AS sample, l_returnflag AS feature, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT sample, feature, round(log2(n / sum(n) OVER (PARTITION BY sample) * 1e6 + 1), 6) AS log_cpm FROM c""")
def log_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    counts = l.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("feature")).agg(F.count("*").alias("n"))
    return contrasts.log_cpm(counts, "sample", "feature", "n").select("sample", "feature", F.round("log_cpm", 6).alias("log_cpm"))


@plan("""WITH m AS (SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1, 2)
SELECT p_brand, p_size, mean FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY mean DESC, p_size) AS r FROM m) WHERE r = 1""")
def best_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return contrasts.best_probe(p, "p_brand", "p_size", "p_retailprice").select("p_brand", "p_size", F.round("mean", 6).alias("mean"))
