"""Joins and spatial joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import joins
from lodestone.plans.common import plan, read

#: A point for every key, in SQL that both engines read.
LAT, LON = "(({k} * 37) % 1000) / 20.0 + 20.0", "(({k} * 91) % 1000) / 10.0 - 100.0"


def points(df: DataFrame, key: str, prefix: str) -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(F.col(key), ((k * 37 % 1000) / 20.0 + 20.0).alias(f"{prefix}lat"), ((k * 91 % 1000) / 10.0 - 100.0).alias(f"{prefix}lon"))


KM = "2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"


@plan("SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders", "customer")
    return o.filter("o_orderstatus = 'F'").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment", "o_totalprice")


@plan("""SELECT n_name, r_name, coalesce(s.n_suppliers, 0) AS n_suppliers, coalesce(c.n_customers, 0) AS n_customers FROM nation
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey""")
def left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s, c = read(spark, sf_dir, "nation", "region", "supplier", "customer")
    s = s.groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    c = c.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    out = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left")
    return out.select("n_name", "r_name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"), F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


_OLD = "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0"
_NEW = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 11 <> 0"


@plan(f"""SELECT count(*) FILTER (b.s_suppkey IS NULL) AS only_old, count(*) FILTER (a.s_suppkey IS NULL) AS only_new,
count(*) FILTER (a.s_acctbal IS DISTINCT FROM b.s_acctbal AND a.s_suppkey IS NOT NULL AND b.s_suppkey IS NOT NULL) AS changed,
count(*) FILTER (a.s_acctbal IS NOT DISTINCT FROM b.s_acctbal AND a.s_suppkey IS NOT NULL AND b.s_suppkey IS NOT NULL) AS same
FROM ({_OLD}) a FULL OUTER JOIN ({_NEW}) b ON a.s_suppkey = b.s_suppkey""")
def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    s = s.select("s_suppkey", "s_name", "s_acctbal")
    old = s.filter("s_suppkey % 7 <> 0")
    new = s.filter("s_suppkey % 11 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return joins.row_diff(old, new, ["s_suppkey"])


@plan("""WITH a AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k, count(*) AS n FROM nation GROUP BY 1),
b AS (SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END AS k, r_name FROM region)
SELECT a.k AS k, n, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation", "region")
    a = n.select(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    b = r.select(F.when(F.col("r_regionkey") != 2, F.col("r_regionkey")).alias("k"), "r_name")
    return joins.null_safe_join(a, b, ["k"])


@plan("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@plan("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@plan("""SELECT n_nationkey, c_mktsegment, coalesce(n, 0) AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)
LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2) USING (c_mktsegment)
WHERE c_nationkey = n_nationkey OR n IS NULL
UNION ALL SELECT n_nationkey, m.c_mktsegment, 0 FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) m
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_acctbal > 5000 AND c.c_nationkey = n_nationkey AND c.c_mktsegment = m.c_mktsegment)""")
def cross_grid_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = read(spark, sf_dir, "nation", "customer")
    facts = c.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    return joins.zero_filled_grid(facts, [n.select("n_nationkey"), c.select("c_mktsegment").distinct()], ["n_nationkey", "c_mktsegment"], ["n"])


@plan("SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS nation FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))
    return a.join(b, on).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.col("a.s_nationkey").alias("nation"))


@plan("SELECT n_nationkey, n_name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def one_to_one_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = read(spark, sf_dir, "nation", "customer")
    return joins.one_to_one(n.select("n_nationkey", "n_name"), c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), ["n_nationkey"])


@plan("""WITH e AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
SELECT event_id, ref_id, ref_value FROM (SELECT p.event_id, e.event_id AS ref_id, round(e.value, 6) AS ref_value, row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts DESC, e.event_id DESC) AS rn
FROM p LEFT JOIN e ON p.user_id = e.user_id AND e.ts <= p.ts) WHERE rn = 1""")
def asof_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    left = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("ref_id"), F.round("value", 6).alias("ref_value"))
    return joins.asof_pick(left, right, "user_id", "ts", "ts", "ref_id", ["ref_id", "ref_value"]).select("event_id", "ref_id", "ref_value")


@plan("""SELECT band, count(*) AS n FROM orders JOIN (SELECT range AS band, range * 50000.0 AS lo, (range + 1) * 50000.0 AS hi FROM range(12)) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1""")
def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    bands = spark.range(12).select(F.col("id").alias("band"), (F.col("id") * 50000.0).alias("lo"), ((F.col("id") + 1) * 50000.0).alias("hi"))
    return joins.interval_stab(o.select("o_totalprice"), "o_totalprice", bands, "lo", "hi", 50000.0).groupBy("band").agg(F.count("*").alias("n"))


@plan("""WITH s AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS rn FROM s) WHERE rn = 1""")
def largest_share_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    shares = l.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    # a text target: the smallest of equal shares by its negative code
    coded = shares.withColumn("code", F.ascii("l_returnflag"))
    return joins.largest_share(coded, "l_suppkey", "code", "n").select("l_suppkey", F.chr("code").alias("l_returnflag"), "n")


@plan(f"""WITH a AS (SELECT s_suppkey, {LAT.format(k="s_suppkey")} AS alat, {LON.format(k="s_suppkey")} AS alon FROM supplier),
b AS (SELECT n_nationkey, {LAT.format(k="n_nationkey")} AS blat, {LON.format(k="n_nationkey")} AS blon FROM nation),
j AS (SELECT s_suppkey, n_nationkey, {KM.format(a="a", b="b")} AS km FROM a, b)
SELECT s_suppkey, n_nationkey, round(km, 4) AS km FROM j WHERE km <= 500""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier", "nation")
    out = joins.radius_join(points(s, "s_suppkey", "a"), points(n, "n_nationkey", "b"), ("alat", "alon"), ("blat", "blon"), 500.0)
    return out.select("s_suppkey", "n_nationkey", F.round("km", 4).alias("km"))


@plan(f"""WITH a AS (SELECT c_custkey, {LAT.format(k="c_custkey")} AS alat, {LON.format(k="c_custkey")} AS alon FROM customer),
b AS (SELECT s_suppkey, {LAT.format(k="s_suppkey")} AS blat, {LON.format(k="s_suppkey")} AS blon FROM supplier),
j AS (SELECT c_custkey, s_suppkey, {KM.format(a="a", b="b")} AS km FROM a, b)
SELECT c_custkey, s_suppkey, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(km, 6), s_suppkey) AS rn FROM j WHERE km <= 300) WHERE rn = 1""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer", "supplier")
    best = joins.nearest_join(points(c, "c_custkey", "a"), points(s, "s_suppkey", "b"), ("alat", "alon"), ("blat", "blon"), "s_suppkey", 300.0)
    return best.select("c_custkey", "s_suppkey", F.round("km", 4).alias("km"))


@plan(f"""WITH a AS (SELECT n_nationkey, {LAT.format(k="n_nationkey")} AS alat, {LON.format(k="n_nationkey")} AS alon FROM nation),
b AS (SELECT s_suppkey, s_nationkey, {LAT.format(k="s_suppkey")} AS blat, {LON.format(k="s_suppkey")} AS blon FROM supplier),
pool AS (SELECT DISTINCT n_nationkey, s_suppkey FROM a, b WHERE s_nationkey = n_nationkey OR {KM.format(a="a", b="b")} <= 800)
SELECT n_nationkey, count(DISTINCT l_partkey) AS n_parts FROM pool JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def pool_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, l = read(spark, sf_dir, "nation", "supplier", "lineitem")
    near = joins.radius_join(points(n, "n_nationkey", "a"), points(s, "s_suppkey", "b"), ("alat", "alon"), ("blat", "blon"), 800.0).select("n_nationkey", "s_suppkey")
    own = s.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey").join(n.select("n_nationkey"), "n_nationkey", "left_semi")
    return joins.distinct_by_pool(near.union(own.select("n_nationkey", "s_suppkey")), "n_nationkey", "s_suppkey", l, "l_suppkey", "l_partkey", "n_parts")


@plan(f"""WITH p AS (SELECT n_nationkey, {LAT.format(k="n_nationkey")} AS alat, {LON.format(k="n_nationkey")} AS alon, n_nationkey * 1.0 AS v FROM nation),
q AS (SELECT n_nationkey AS m, alat AS blat, alon AS blon, v AS u FROM p), z AS (SELECT avg(v) AS mu, sum((v - (SELECT avg(v) FROM p)) ** 2) AS ss, count(*) AS n FROM p),
e AS (SELECT n_nationkey, m, v, u FROM p, q WHERE n_nationkey <> m AND {KM.format(a="a", b="b")} <= 3000), d AS (SELECT n_nationkey, count(*) AS deg FROM e GROUP BY 1)
SELECT round(max(n) / count(DISTINCT e.n_nationkey) * sum((v - mu) * (u - mu) / deg) / max(ss), 6) AS i FROM e JOIN d USING (n_nationkey), z""")
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I with row-standardised weights of neighbours within 3,000 km."""
    (n,) = read(spark, sf_dir, "nation")
    p = points(n, "n_nationkey", "a").withColumn("v", F.col("n_nationkey") * 1.0)
    q = points(n, "n_nationkey", "b").select(F.col("n_nationkey").alias("m"), "blat", "blon", (F.col("n_nationkey") * 1.0).alias("u"))
    e = joins.radius_join(p, q, ("alat", "alon"), ("blat", "blon"), 3000.0).filter("n_nationkey <> m").withColumn("deg", F.count("*").over(Window.partitionBy("n_nationkey")))
    z = p.agg(F.avg("v").alias("mu"), (F.var_pop("v") * F.count("*")).alias("ss"), F.count("*").alias("n"))
    e = e.crossJoin(F.broadcast(z))
    return e.agg(F.round(F.max("n") / F.countDistinct("n_nationkey") * F.sum((F.col("v") - F.col("mu")) * (F.col("u") - F.col("mu")) / F.col("deg")) / F.max("ss"), 6).alias("i"))
