"""Aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import aggregates
from lodestone.plans.common import plan, read


@plan("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc,
count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2""")
def multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@plan("""SELECT user_id, count(DISTINCT CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS buy_days, count(DISTINCT CASE WHEN event_type = 'click' THEN CAST(ts AS DATE) END) AS click_days,
count(*) FILTER (value > 50) AS n_high FROM events GROUP BY 1""")
def filtered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    return e.groupBy("user_id").agg(
        F.countDistinct(F.when(F.col("event_type") == "purchase", day)).alias("buy_days"), F.countDistinct(F.when(F.col("event_type") == "click", day)).alias("click_days"), F.count_if(F.col("value") > 50).alias("n_high")
    )


@plan("""SELECT o_custkey, arg_min(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) FILTER (o_orderstatus = 'F') AS cheapest, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS dearest FROM orders GROUP BY 1""")
def argmin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    order = F.struct("o_totalprice", "o_orderkey")
    return o.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", order)).alias("cheapest"), F.max_by("o_orderkey", order).alias("dearest")
    )


@plan("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY 1")
def bool_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_big"))


@plan("SELECT s_nationkey, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS brands FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def sorted_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, p = read(spark, sf_dir, "lineitem", "supplier", "part")
    j = l.select("l_suppkey", "l_partkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("s_nationkey").agg(aggregates.sorted_list_text(F.col("p_brand")).alias("brands"))


@plan("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    return aggregates.mode_smallest(e, ["user_id"], "event_type", "mode")


@plan("""SELECT l_suppkey, round(sum(l_quantity * d) / nullif(sum(CASE WHEN d IS NOT NULL THEN l_quantity END), 0), 6) AS mean_discount
FROM (SELECT l_suppkey, l_quantity, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS d FROM lineitem) GROUP BY 1""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    d = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
    return l.groupBy("l_suppkey").agg(F.round(aggregates.weighted_mean(d, F.col("l_quantity")), 6).alias("mean_discount"))


@plan("""WITH u AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, o_orderstatus = 'O' AS child, max(o_totalprice) AS a FROM orders GROUP BY ALL)
SELECT o_custkey, y, round(coalesce(sum(a) FILTER (NOT child), sum(a) FILTER (child)), 2) AS total FROM u GROUP BY 1, 2""")
def parent_child_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("y"), (F.col("o_orderstatus") == "O").alias("child"), "o_totalprice")
    return aggregates.parent_child_sum(o, ["o_custkey", "y"], "child", "o_totalprice", "o_orderkey").select("o_custkey", "y", F.round("total", 2).alias("total"))


@plan("""SELECT coalesce(c_mktsegment, 'all') AS segment, CASE WHEN grouping(c_nationkey) = 1 THEN -1 ELSE c_nationkey END AS nation, count(*) AS n, grouping(c_mktsegment)::INT AS g1, grouping(c_nationkey)::INT AS g2
FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def margins_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    out = c.cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").cast("int").alias("g1"), F.grouping("c_nationkey").cast("int").alias("g2"))
    return out.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.when(F.col("g2") == 1, -1).otherwise(F.col("c_nationkey")).alias("nation"), "n", "g1", "g2")


@plan("SELECT coalesce(n_regionkey, -1) AS region, coalesce(n_nationkey, -1) AS nation, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = read(spark, sf_dir, "nation", "supplier")
    out = n.join(s, n.n_nationkey == s.s_nationkey).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.coalesce("n_nationkey", F.lit(-1)).alias("nation"), "n")


@plan("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return l.groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@plan("""WITH c AS (SELECT s_nationkey, s_suppkey % 4 AS cell, count(*) AS n FROM supplier GROUP BY 1, 2), f AS (SELECT *, n <= 1 AS small FROM c),
g AS (SELECT *, count(*) FILTER (small) OVER (PARTITION BY s_nationkey) AS hidden, row_number() OVER (PARTITION BY s_nationkey, small ORDER BY n, cell) AS rn FROM f)
SELECT s_nationkey, cell, CASE WHEN NOT (small OR (hidden = 1 AND rn = 1)) THEN n END AS shown, small OR (hidden = 1 AND rn = 1) AS suppressed FROM g""")
def suppress_complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    counts = s.groupBy("s_nationkey", (F.col("s_suppkey") % 4).alias("cell")).agg(F.count("*").alias("n"))
    return aggregates.suppress(counts, ["s_nationkey"], "cell", "n", 1)


@plan("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 4) AS q025, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.975), 4) AS q975,
quantile_disc(o_totalprice, 0.5) AS d50 FROM orders GROUP BY 1""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    q = F.percentile("o_totalprice", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = o.groupBy("o_orderpriority").agg(q.alias("q"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice)").alias("d50"))
    return out.select("o_orderpriority", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q025", "q50", "q975"))], "d50")


@plan("""WITH s AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, (sum(w) OVER (PARTITION BY l_returnflag ORDER BY x ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY l_returnflag) AS p FROM s),
b AS (SELECT l_returnflag, max({'p': p, 'v': x}) FILTER (p <= 0.5) AS l, min({'p': p, 'v': x}) FILTER (p >= 0.5) AS h FROM p GROUP BY 1)
SELECT l_returnflag, round(CASE WHEN l IS NULL THEN h.v WHEN h IS NULL OR l.p = h.p THEN l.v ELSE l.v + (h.v - l.v) * (0.5 - l.p) / (h.p - l.p) END, 4) AS q50 FROM b""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return aggregates.weighted_quantile(l, ["l_returnflag"], "l_extendedprice", "l_quantity", 0.5, "q50").select("l_returnflag", F.round("q50", 4).alias("q50"))


_HOLES = "SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS a, CASE WHEN l_returnflag = 'R' THEN l_tax END AS b, l_quantity AS c FROM lineitem"


@plan(f"""SELECT 'a' AS column_name, count(*) FILTER (a IS NULL) AS nulls, round(count(*) FILTER (a IS NULL) / count(*), 6) AS null_share FROM ({_HOLES}) UNION ALL
SELECT 'b', count(*) FILTER (b IS NULL), round(count(*) FILTER (b IS NULL) / count(*), 6) FROM ({_HOLES}) UNION ALL SELECT 'c', count(*) FILTER (c IS NULL), round(count(*) FILTER (c IS NULL) / count(*), 6) FROM ({_HOLES})""")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    holes = l.select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("a"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("b"), F.col("l_quantity").alias("c"))
    return aggregates.null_profile(holes, ["a", "b", "c"]).withColumn("null_share", F.round("null_share", 6))


@plan("""WITH u AS (SELECT user_id, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase' AND value > 90) AS p, bool_or(value > 99) AS h FROM events GROUP BY 1)
SELECT concat_ws('&', CASE WHEN c THEN 'click' END, CASE WHEN p THEN 'buy' END, CASE WHEN h THEN 'high' END) AS pattern, count(*) AS n FROM u GROUP BY 1""")
def upset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    flags = {"click": F.col("event_type") == "click", "buy": (F.col("event_type") == "purchase") & (F.col("value") > 90), "high": F.col("value") > 99}
    return aggregates.upset_counts(e, "user_id", flags)


_LINE = ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']


@plan(f"""SELECT count(*) AS rows, sum(('0x' || substr(md5(concat_ws(',', {', '.join(f"coalesce(length({c}::VARCHAR)::VARCHAR, '-') || ':' || coalesce({c}::VARCHAR, 'null')" for c in _LINE)})), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS hash FROM lineitem""")
def table_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return aggregates.table_hash(l)


@plan("SELECT l_suppkey, round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 6) AS n_eff FROM lineitem GROUP BY 1")
def kish_effective_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return l.groupBy("l_suppkey").agg(F.round(aggregates.kish_effective_n(F.col("l_quantity")), 6).alias("n_eff"))


@plan("SELECT c_mktsegment, count(*) FILTER (c_nationkey < 10) AS low, count(*) FILTER (c_nationkey >= 10) AS high FROM customer GROUP BY 1")
def cross_tabulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    side = F.when(F.col("c_nationkey") < 10, "low").otherwise("high")
    return c.withColumn("side", side).groupBy("c_mktsegment").pivot("side", ["low", "high"]).count()


@plan("""WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || n, '; ' ORDER BY event_type) AS counts FROM t GROUP BY 1""")
def value_count_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    t = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return t.groupBy("user_id").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["event_type"], p["n"])), "; ").alias("counts"))


@plan("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n < 80 THEN 'other' ELSE p_brand END AS brand, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def small_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    c = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    return c.groupBy(F.when(F.col("n") < 80, "other").otherwise(F.col("p_brand")).alias("brand")).agg(F.sum("n").alias("n"))
