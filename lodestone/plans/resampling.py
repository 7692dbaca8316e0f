"""Permutation nulls, bootstraps and rank concordance; random numbers are md5 digits, which the SQL repeats."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import concordance, draws
from lodestone.plans.common import plan, read


def _u(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 12))::BIGINT"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


_XY = "SELECT doc_id, n_chars AS x, quality AS y, lang FROM documents JOIN labels USING (doc_id)"


def _null_sql(by: str) -> str:
    over = f"PARTITION BY d{', lang' if by else ''}"
    sizes = "count(*) FILTER (y = 1) OVER (PARTITION BY lang)" if by else "count(*) FILTER (y = 1) OVER ()"
    return f"""WITH r AS (SELECT *, {sizes} AS n1 FROM ({_XY}) WHERE x IS NOT NULL AND y IS NOT NULL), o AS (SELECT avg(x) FILTER (y = 1) - avg(x) FILTER (y <> 1) AS o FROM r),
u AS (SELECT d, lang, x, n1, row_number() OVER ({over} ORDER BY {_u("'5'", "d", "doc_id")}, doc_id) AS i FROM r, range(200) AS t(d)),
t AS (SELECT d, avg(x) FILTER (i <= n1) - avg(x) FILTER (i > n1) AS t FROM u GROUP BY d), s AS (SELECT avg(t) AS c, quantile_cont(t, 0.025) AS low, quantile_cont(t, 0.975) AS high, count(*) AS draws FROM t)
SELECT round(o, 9) AS observed, round(c, 9) AS null_mean, round(low, 9) AS null_low, round(high, 9) AS null_high, round((SELECT count(*) + 1 FROM t WHERE abs(t) >= abs(o) - 1e-12) / (draws + 1), 9) AS p,
  round((SELECT count(*) + 1 FROM t WHERE abs(t - c) >= abs(o - c) - 1e-12) / (draws + 1), 9) AS p_centre, round(c / o, 9) AS retained, draws FROM s, o"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents", "labels")
    return d.select("doc_id", "n_chars", "lang").join(l, "doc_id")


_SUMMARY = ("observed", "null_mean", "null_low", "null_high", "p", "p_centre", "retained")


@plan(_null_sql(""))
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts of good and bad quality against labels dealt anew, always as many good ones."""
    return _rounded(draws.permutation_null(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, "doc_id", 200, 5), *_SUMMARY)


@plan(_null_sql("lang"))
def permutation_null_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with labels dealt anew within each language, so that its null isn't centred at nothing."""
    return _rounded(draws.permutation_null(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, "doc_id", 200, 5, ["lang"]), *_SUMMARY)


def _interval_sql(means: str) -> str:
    return f"{means} SELECT round(quantile_cont(t, 0.025), 9) AS low, round(quantile_cont(t, 0.975), 9) AS high, count(*) AS draws FROM t"


@plan(_interval_sql(f"""WITH k AS (SELECT s_suppkey AS c, s_acctbal AS s, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS k FROM supplier WHERE s_acctbal IS NOT NULL),
w AS (SELECT d, {_u("'11'", "d", "i")} % k AS i FROM k, range(200) AS r(d)), t AS (SELECT d, avg(s) AS t FROM w JOIN k USING (i) GROUP BY d)"""))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean balance of the suppliers, each drawn by itself."""
    (s,) = read(spark, sf_dir, "supplier")
    return _rounded(draws.interval(draws.bootstrap_means(s, "s_acctbal", "s_suppkey", 200, 11)), "low", "high")


@plan(_interval_sql(f"""WITH k AS (SELECT c, s, n, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS k FROM (SELECT o_custkey AS c, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)),
w AS (SELECT d, {_u("'12'", "d", "i")} % k AS i FROM k, range(40) AS r(d)), t AS (SELECT d, sum(s) / sum(n) AS t FROM w JOIN k USING (i) GROUP BY d)"""))
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price, customers drawn with all their orders."""
    (o,) = read(spark, sf_dir, "orders")
    return _rounded(draws.interval(draws.bootstrap_means(o, "o_totalprice", "o_custkey", 40, 12)), "low", "high")


@plan(_interval_sql(f"""WITH k AS (SELECT h, c, s, n, row_number() OVER (PARTITION BY h ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY h) AS k FROM (SELECT c_mktsegment AS h, c_nationkey AS c, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1, 2)),
w AS (SELECT d, h, {_u("'13'", "d", "h", "i")} % k AS i FROM k, range(200) AS r(d)), t AS (SELECT d, sum(s) / sum(n) AS t FROM w JOIN k USING (h, i) GROUP BY d)"""))
def bootstrap_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean balance, nations drawn within each market segment."""
    (c,) = read(spark, sf_dir, "customer")
    return _rounded(draws.interval(draws.bootstrap_means(c, "c_acctbal", "c_nationkey", 200, 13, ["c_mktsegment"])), "low", "high")


@plan(_interval_sql(f"""WITH k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT s_nationkey AS c FROM supplier)),
w AS (SELECT d, {_u("'14'", "d", "i")} % k AS i FROM k, range(60) AS r(d)), s AS (SELECT d, s_acctbal AS x, s_suppkey * 7919 % 997 AS y FROM w JOIN k USING (i) JOIN supplier ON s_nationkey = c),
q AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY x) + (count(*) OVER (PARTITION BY d, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2.0 AS b FROM s),
t AS (SELECT d, corr(a, b) AS t FROM q GROUP BY d)"""))
def bootstrap_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's correlation over the suppliers of drawn nations."""
    (s,) = read(spark, sf_dir, "supplier")
    rows = s.select("s_nationkey", "s_acctbal", (F.col("s_suppkey") * 7919 % 997).alias("y"))
    return _rounded(draws.interval(draws.bootstrap_spearman(rows, "s_acctbal", "y", "s_nationkey", 60, 14)), "low", "high")


@plan("""WITH r AS (SELECT c_custkey AS i, floor(c_acctbal / 10) AS x, c_custkey * 7919 % 997 AS y FROM customer WHERE c_acctbal IS NOT NULL), p AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM r a JOIN r b ON a.i < b.i),
s AS (SELECT count(*) FILTER (sx * sy > 0) AS concordant, count(*) FILTER (sx * sy < 0) AS discordant, count(*) FILTER (sx = 0) AS ties_x, count(*) FILTER (sy = 0) AS ties_y, count(*) AS whole FROM p)
SELECT round((concordant - discordant) / sqrt((whole - ties_x)::DOUBLE * (whole - ties_y)), 9) AS tau_b, (SELECT count(*) FROM r) AS n, concordant, discordant, ties_x, ties_y FROM s""")
def kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    rows = c.select(F.floor(F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") * 7919 % 997).alias("y"))
    out = concordance.kendall_tau_b(rows, "x", "y")
    return out.select(F.round("tau_b", 9).alias("tau_b"), *[F.col(c).cast("long").alias(c) for c in ("n", "concordant", "discordant", "ties_x", "ties_y")])
