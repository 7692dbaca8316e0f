"""Windows, rankings and top-k."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import ranking
from lodestone.plans.common import plan, read

_AVG_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


@plan(f"""WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN floor(s_acctbal / 500) END AS v FROM supplier),
r AS (SELECT s_suppkey, {_AVG_RANK.format(x="v")} / count(*) OVER () AS p FROM x WHERE v IS NOT NULL)
SELECT s_suppkey, round(p, 9) AS p FROM x LEFT JOIN r USING (s_suppkey)""")
def pct_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    x = s.select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.floor(F.col("s_acctbal") / 500)).alias("v"))
    return ranking.percentile_rank(x, "v", "p").select("s_suppkey", F.round("p", 9).alias("p"))


@plan("""WITH x AS (SELECT s_suppkey, floor(s_acctbal / 500) AS v, s_suppkey % 3 <> 0 AS ref FROM supplier),
c AS (SELECT a.s_suppkey, a.ref, count(*) FILTER (b.v < a.v) AS lt, count(*) FILTER (b.v = a.v) AS eq, count(*) AS n FROM x a JOIN x b ON b.ref GROUP BY 1, 2)
SELECT s_suppkey, round(CASE WHEN ref THEN (lt + (eq + 1) / 2) / n ELSE (lt + (eq + 2) / 2) / (n + 1) END, 9) AS p FROM c""")
def ref_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    x = s.select("s_suppkey", F.floor(F.col("s_acctbal") / 500).alias("v"), (F.col("s_suppkey") % 3 != 0).alias("ref"))
    return ranking.ref_percentile(x, "v", "ref", "p").select("s_suppkey", F.round("p", 9).alias("p"))


@plan("""WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN floor(s_acctbal / 500) END AS v, s_nationkey < 20 AS ok FROM supplier),
r AS (SELECT s_suppkey, row_number() OVER (ORDER BY v DESC, s_suppkey) AS rn FROM x WHERE ok AND v IS NOT NULL) SELECT s_suppkey, rn FROM x LEFT JOIN r USING (s_suppkey)""")
def rank_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    x = s.select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 9 != 0, F.floor(F.col("s_acctbal") / 500)).alias("v"))
    return ranking.rank_eligible(x, "v", F.col("s_nationkey") < 20, ["s_suppkey"], "rn").select("s_suppkey", F.col("rn").cast("long").alias("rn"))


@plan("""WITH x AS (SELECT s_nationkey, p_brand, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT s_nationkey, p_brand, row_number() OVER (ORDER BY v DESC, s_nationkey, p_brand) AS rn FROM x""")
def joint_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, p = read(spark, sf_dir, "lineitem", "supplier", "part")
    x = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("s_nationkey", "p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return ranking.number_rows(x, F.col("v"), ["s_nationkey", "p_brand"], "rn").select("s_nationkey", "p_brand", "rn")


@plan("WITH d AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, code FROM part JOIN d USING (p_brand)")
def dense_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return ranking.dense_code(p, "p_brand", "code").select("p_partkey", F.col("code").cast("long").alias("code"))


@plan("""WITH a AS (SELECT o_orderkey, o_custkey, c_nationkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS q FROM a WHERE r <= 2) SELECT o_orderkey, o_custkey, c_nationkey FROM b WHERE q <= 5""")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders", "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return ranking.cap_per_group(j, ["o_custkey"], 2, ["c_nationkey"], 5, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "c_nationkey")


@plan("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
f AS (SELECT *, lag(y) OVER w AS py, lead(y) OVER w AS ny, lag(n) OVER w AS pn, lead(n) OVER w AS nn FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY y))
SELECT o_custkey, y, n, n = 1 AND py = y - 1 AND ny = y + 1 AND pn >= 2 AND nn >= 2 AS suspect FROM f WHERE py IS NOT NULL AND ny IS NOT NULL""")
def lag_gap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    y = o.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("y")
    f = y.select("*", F.lag("y").over(w).alias("py"), F.lead("y").over(w).alias("ny"), F.lag("n").over(w).alias("pn"), F.lead("n").over(w).alias("nn")).filter("py IS NOT NULL AND ny IS NOT NULL")
    return f.select("o_custkey", "y", "n", F.expr("n = 1 AND py = y - 1 AND ny = y + 1 AND pn >= 2 AND nn >= 2").alias("suspect"))


@plan("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY 1, 2""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = ~F.coalesce(F.expr("timestampdiff(MICROSECOND, prev, ts)") <= F.lit(6 * 3600 * 1_000_000).cast("long"), F.lit(False))
    e = e.withColumn("prev", F.lag("ts").over(w))
    out = ranking.islands(e, ["user_id"], ["ts", "event_id"], gap, "island")
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@plan("""SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled
FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)""")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    e = e.withColumn("v", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    return ranking.forward_fill(e, ["user_id"], ["ts", "event_id"], "v", "filled").select("event_id", "filled")


@plan("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return ranking.latest_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@plan("""WITH e AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rb FROM e) SELECT a, b, s FROM r WHERE ra = 1 AND rb = 1""")
def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    e = l.groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).agg(F.sum("l_quantity").alias("s"))
    return ranking.mutual_best(e, "a", "b", "s")


@plan("""WITH x AS (SELECT c_custkey, floor(c_acctbal / 250) AS v FROM customer), r AS (SELECT *, rank() OVER (ORDER BY v DESC) - 1 AS above, count(*) OVER (PARTITION BY v) AS tied FROM x)
SELECT c_custkey, round(least(1.0, greatest(0.0, (100 - above) / tied)), 9) AS p FROM r""")
def topn_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    x = c.select("c_custkey", F.floor(F.col("c_acctbal") / 250).alias("v"))
    return ranking.topn_inclusion(x, "v", 100, "p").select("c_custkey", F.round("p", 9).alias("p"))


@plan("""SELECT c_nationkey, c_custkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    out = ranking.top_k_per_group(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return out.select("c_nationkey", "c_custkey", F.col("rn").cast("long").alias("rn"))


@plan("""WITH x AS (SELECT d.doc_id, quality AS y, row_number() OVER (ORDER BY n_chars DESC, d.doc_id) AS rn, count(*) OVER () AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT round(avg(y) FILTER (rn <= ceil(n / 10.0)), 6) AS hit_rate, round(avg(y), 6) AS base_rate, round(avg(y) FILTER (rn <= ceil(n / 10.0)) / avg(y), 6) AS lift FROM x""")
def decile_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents", "labels")
    j = d.select("doc_id", "n_chars").join(l, "doc_id")
    ranked = ranking.number_rows(j, F.col("n_chars"), ["doc_id"], "rn", total="n")
    both = ranked.agg(F.avg(F.when(F.col("rn") <= F.ceil(F.col("n") / 10), F.col("quality"))).alias("hit"), F.avg("quality").alias("base"))
    return both.select(F.round("hit", 6).alias("hit_rate"), F.round("base", 6).alias("base_rate"), F.round(F.try_divide("hit", "base"), 6).alias("lift"))


@plan("""WITH s AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, n, round(sum(o_totalprice), 2) AS total FROM s GROUP BY 1, 2""")
def permute_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle within groups keeps each group's size and sum."""
    (o,) = read(spark, sf_dir, "orders")
    out = ranking.permute_within(o.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_orderkey", "o_totalprice", 7, "shuffled")
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("shuffled"), 2).alias("total"))


@plan("""SELECT l_orderkey, l_partkey, l_shipdate, round(sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), 4) AS q30
FROM lineitem""")
def rolling_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    l = l.withColumn("day", F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("l_partkey").orderBy("day").rangeBetween(-30, 0)
    return l.select("l_orderkey", "l_partkey", "l_shipdate", F.round(F.sum("l_quantity").over(w), 4).alias("q30"))
