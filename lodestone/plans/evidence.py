"""Joins, windows and summaries that the domain tables need, on the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import entity
from lodestone.plans.common import plan, read


@plan("""SELECT n_nationkey, n_name, coalesce(k, 0) AS k FROM (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def right_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference row stays, found or not."""
    s, n = read(spark, sf_dir, "supplier", "nation")
    found = s.filter("s_acctbal > 8000").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    return found.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_nationkey", "n_name", F.coalesce("k", F.lit(0)).cast("long").alias("k"))


@plan("""WITH y AS (SELECT c_nationkey AS nation, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
r AS (SELECT n_regionkey AS region, nation, y, n FROM y JOIN nation ON nation = n_nationkey)
SELECT nation, y::INT AS y, n, lag(n) OVER w AS before_n, lead(n) OVER w AS after_n, n < lag(n) OVER w AND n < lead(n) OVER w AS dip FROM r WINDOW w AS (PARTITION BY nation ORDER BY y)""")
def neighbour_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year below both neighbours."""
    o, c = read(spark, sf_dir, "orders", "customer")
    per = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("nation").orderBy("y")
    out = per.select("nation", "y", "n", F.lag("n").over(w).alias("before_n"), F.lead("n").over(w).alias("after_n"))
    return out.withColumn("dip", (F.col("n") < F.col("before_n")) & (F.col("n") < F.col("after_n")))


@plan("""SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS group_n, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS centred,
rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)::INT AS competition FROM supplier""")
def group_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group size, deviation from the group's mean, competition rank."""
    (s,) = read(spark, sf_dir, "supplier")
    w = Window.partitionBy("s_nationkey")
    centred = F.round(F.col("s_acctbal") - F.avg("s_acctbal").over(w), 6).alias("centred")
    return s.select("s_suppkey", "s_nationkey", F.count("*").over(w).alias("group_n"), centred, F.rank().over(w.orderBy(F.desc("s_acctbal"))).alias("competition"))


@plan("""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_suppkey, CASE WHEN r = 1 THEN 0 ELSE (ceil((r - 1) * 10.0 / (n - 1)) - 1)::INT END AS bin FROM r""")
def first_rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by first occurrence cut at interpolated tenths, edges closed on the right."""
    (s,) = read(spark, sf_dir, "supplier")
    w = Window.partitionBy("s_nationkey")
    r = F.row_number().over(w.orderBy("s_acctbal", "s_suppkey"))
    s = s.select("s_suppkey", r.alias("r"), F.count("*").over(w).alias("n"))
    return s.select("s_suppkey", F.when(F.col("r") == 1, 0).otherwise((F.ceil((F.col("r") - 1) * 10.0 / (F.col("n") - 1)) - 1).cast("int")).alias("bin"))


@plan("""WITH m AS (SELECT DISTINCT c_mktsegment AS s, o_orderpriority AS p, c_custkey AS x FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT DISTINCT s, x FROM m), b AS (SELECT DISTINCT p, x FROM m), na AS (SELECT s, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT p, count(*) AS nb FROM b GROUP BY 1)
SELECT s, p, count(*) AS both_n, any_value(na) AS s_n, any_value(nb) AS p_n FROM a JOIN b USING (x) JOIN na USING (s) JOIN nb USING (p) GROUP BY 1, 2""")
def set_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared elements of every pair of sets from two sources, with both sizes."""
    o, c = read(spark, sf_dir, "orders", "customer")
    m = o.join(c, o.o_custkey == c.c_custkey)
    a = m.select(F.col("c_mktsegment").alias("s"), F.col("c_custkey").alias("x")).distinct()
    b = m.select(F.col("o_orderpriority").alias("p"), F.col("c_custkey").alias("x")).distinct()
    sizes = [a.groupBy("s").agg(F.count("*").alias("s_n")), b.groupBy("p").agg(F.count("*").alias("p_n"))]
    return a.join(b, "x").groupBy("s", "p").agg(F.count("*").alias("both_n")).join(sizes[0], "s").join(sizes[1], "p").select("s", "p", "both_n", "s_n", "p_n")


@plan("""WITH RECURSIVE up(node, ancestor) AS (SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey // 4 > 0 UNION ALL SELECT node, ancestor // 4 FROM up WHERE ancestor // 4 > 0)
SELECT node, ancestor FROM up""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors in a parent map."""
    (p,) = read(spark, sf_dir, "part")
    parents = p.select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 4").alias("parent")).filter("parent > 0")
    return entity.ancestors(parents)


@plan("""WITH q AS (SELECT o_orderkey, o_orderkey * 3 % 4000 AS k FROM orders), a AS (SELECT p_partkey AS k, p_name AS x FROM part WHERE p_size <= 20),
b AS (SELECT p_partkey + 1000 AS k, min(p_name) AS x FROM part WHERE p_size > 40 GROUP BY 1), c AS (SELECT s_suppkey AS k, s_name AS x FROM supplier)
SELECT o_orderkey, coalesce(a.x, b.x, c.x) AS symbol, CASE WHEN a.x IS NOT NULL THEN 'approved' WHEN b.x IS NOT NULL THEN 'alias' WHEN c.x IS NOT NULL THEN 'previous' END AS method
FROM q LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)""")
def symbol_harmonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved, else alias, else previous symbol, with the method."""
    o, p, s = read(spark, sf_dir, "orders", "part", "supplier")
    q = o.select("o_orderkey", (F.col("o_orderkey") * 3 % 4000).alias("k"))
    a = p.filter("p_size <= 20").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"))
    b = p.filter("p_size > 40").groupBy((F.col("p_partkey") + 1000).alias("k")).agg(F.min("p_name").alias("b"))
    c = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("c"))
    out = q.join(a, "k", "left").join(b, "k", "left").join(c, "k", "left")
    method = F.when(F.col("a").isNotNull(), "approved").when(F.col("b").isNotNull(), "alias").when(F.col("c").isNotNull(), "previous")
    return out.select("o_orderkey", F.coalesce("a", "b", "c").alias("symbol"), method.alias("method"))


@plan("""WITH g AS (SELECT c_nationkey AS nation, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0) AS own FROM customer GROUP BY 1),
r AS (SELECT n_regionkey, avg(c_acctbal) AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, round(coalesce(own, parent), 4) AS value, own IS NULL AS inherited FROM nation LEFT JOIN g ON nation = n_nationkey LEFT JOIN r USING (n_regionkey)""")
def inherited_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's value where a nation has none of its own, flagged."""
    c, n = read(spark, sf_dir, "customer", "nation")
    own = c.groupBy("c_nationkey").agg(F.avg(F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 3 == 0), F.col("c_acctbal"))).alias("own"))
    parent = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(F.avg("c_acctbal").alias("parent"))
    out = n.join(own, n.n_nationkey == own.c_nationkey, "left").join(parent, "n_regionkey", "left")
    return out.select("n_nationkey", F.round(F.coalesce("own", "parent"), 4).alias("value"), F.col("own").isNull().alias("inherited"))


@plan("""WITH y AS (SELECT c_nationkey AS nation, count(*) FILTER (year(o_orderdate) IN (1996, 1997)) AS n, count(DISTINCT c_custkey) AS people, max(year(o_orderdate)) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT nation, round(n / (2.0 * people) * 1000, 6) AS pooled, CASE WHEN n > 0 THEN 'present' WHEN last IS NULL THEN 'absent' ELSE 'other year' END AS reason FROM y""")
def pooled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate pooled over two years, and why it is missing where it is."""
    o, c = read(spark, sf_dir, "orders", "customer")
    year = F.year("o_orderdate")
    y = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count_if(year.isin(1996, 1997)).alias("n"), F.count_distinct("c_custkey").alias("people"), F.max(year).alias("last")
    )
    reason = F.when(F.col("n") > 0, "present").when(F.col("last").isNull(), "absent").otherwise("other year")
    return y.select("nation", F.round(F.col("n") / (2.0 * F.col("people")) * 1000, 6).alias("pooled"), reason.alias("reason"))


@plan("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_tax, l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem),
x AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N') AS conflict FROM lineitem GROUP BY 1)
SELECT l_partkey, l_orderkey, l_discount, conflict FROM r JOIN x USING (l_partkey) WHERE r = 1""")
def record_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record by several keys, and whether another contradicts it."""
    (l,) = read(spark, sf_dir, "lineitem")
    order = F.struct(-F.col("l_discount"), "l_tax", -F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey")
    flags = [F.bool_or(F.col("l_returnflag") == x) for x in "RN"]
    best = l.groupBy("l_partkey").agg(F.min_by(F.struct("l_orderkey", "l_discount"), order).alias("b"), (flags[0] & flags[1]).alias("conflict"))
    return best.select("l_partkey", "b.l_orderkey", "b.l_discount", "conflict")


@plan("""WITH t AS (SELECT p_brand AS pathway, p_name AS name, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT pathway, count(*) AS n, string_agg(k::VARCHAR, ';' ORDER BY r) FILTER (r <= 3) AS top FROM t GROUP BY 1""")
def pathway_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members counted, and the top three joined to text."""
    (p,) = read(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "p_partkey"))))
    out = p.withColumn("r", F.row_number().over(w)).groupBy(F.col("p_brand").alias("pathway")).agg(F.count("*").alias("n"), top.alias("top"))
    return out.select("pathway", "n", F.array_join(F.transform("top", lambda x: x["p_partkey"].cast("string")), ";").alias("top"))


@plan("""WITH b AS (SELECT user_id, epoch_us(ts) // 14400000000 AS bin, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, bin, n, CASE WHEN n >= 2 THEN round(m, 6) END AS mean FROM b""")
def bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of four-hour bins, null where fewer than two values fall in one."""
    (e,) = read(spark, sf_dir, "events")
    bins = F.expr("unix_micros(cast(ts AS timestamp)) div 14400000000").alias("bin")
    return e.groupBy("user_id", bins).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 2, F.avg("value")), 6).alias("mean"))


@plan("""WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS days, round(stddev_samp(v) / avg(v), 6) AS cv, round(avg(v) FILTER (isodow(day) >= 6) - avg(v) FILTER (isodow(day) < 6), 6) AS weekend FROM d GROUP BY 1""")
def day_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient of variation of the daily sums, and weekend minus weekday."""
    (e,) = read(spark, sf_dir, "events")
    d = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    weekend = F.weekday("day") >= 5
    diff = F.avg(F.when(weekend, F.col("v"))) - F.avg(F.when(~weekend, F.col("v")))
    return d.groupBy("user_id").agg(F.count("*").alias("days"), F.round(F.stddev_samp("v") / F.avg("v"), 6).alias("cv"), F.round(diff, 6).alias("weekend"))


@plan("""WITH s AS (SELECT user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 21600 THEN 1 ELSE 0 END AS cut, event_id FROM events),
g AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s), l AS (SELECT user_id, g, min(ts) AS start, max(ts) AS stop FROM g GROUP BY 1, 2)
SELECT user_id, date_diff('second', start, stop) AS seconds, g::BIGINT AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_diff('second', start, stop) DESC, start) AS r FROM l) WHERE r = 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's longest run of events, gaps of up to six hours bridged."""
    (e,) = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    second = F.expr("unix_micros(cast(date_trunc('second', ts) AS timestamp)) div 1000000")
    e = e.select("user_id", "ts", "event_id", second.alias("t"))
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > 21600).cast("long"), F.lit(0).cast("long"))
    runs = e.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w)).groupBy("user_id", "run").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("seconds"))
    best = runs.groupBy("user_id").agg(F.min_by(F.struct("seconds", "run"), F.struct(-F.col("seconds"), "start")).alias("b"))
    return best.select("user_id", "b.seconds", "b.run")


@plan("""WITH x AS (SELECT year(o_orderdate)::INT AS y, 'orders' AS src, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 UNION ALL SELECT year(l_shipdate)::INT, 'lines', round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 1)
SELECT y, max(total) FILTER (src = 'orders') AS orders_total, max(total) FILTER (src = 'lines') AS lines_total FROM x GROUP BY 1""")
def yearly_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals of two sources side by side."""
    o, l = read(spark, sf_dir, "orders", "lineitem")
    a = o.groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("orders_total"))
    b = l.groupBy(F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_extendedprice"), 2).alias("lines_total"))
    return a.join(b, "y", "full_outer").select("y", "orders_total", "lines_total")


@plan("""WITH m AS (SELECT DISTINCT event_type AS e, user_id FROM events)
SELECT a.e AS a, b.e AS b, count(*) AS shared FROM m a JOIN m b ON a.user_id = b.user_id AND a.e < b.e GROUP BY 1, 2""")
def linkage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that every pair of modalities shares."""
    (e,) = read(spark, sf_dir, "events")
    m = e.select(F.col("event_type").alias("a"), "user_id").distinct()
    return m.join(m.withColumnRenamed("a", "b"), "user_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
