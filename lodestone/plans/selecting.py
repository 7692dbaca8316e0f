"""Intervals, neighbours, permuted autocorrelation, feature filters, components, turns, ladders and bridges on the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import draws, intervals, moran, selection, statistics
from lodestone.plans.common import plan, read
from lodestone.plans.places import _NATION_EDGES, _nations
from lodestone.plans.resampling import _SUMMARY, _rounded, _u


@plan()
def jeffreys_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of returned lines of each supplier; beta quantiles, which SQL lacks."""
    (l,) = read(spark, sf_dir, "lineitem")
    k = l.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("n"))
    return intervals.jeffreys(k, "hits", "n")


@plan()
def survey_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design-based share of odd customers in each market segment with its exact interval and whether it may be shown."""
    c, n = read(spark, sf_dir, "customer", "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey).select("n_regionkey", "c_nationkey", F.abs("c_acctbal").alias("w"), (F.col("c_custkey") % 2).cast("double").alias("y"), "c_mktsegment")
    out = None
    for s in sorted(r[0] for r in c.select("c_mktsegment").distinct().collect()):  # five
        one = statistics.taylor_mean(j, "y", "w", "n_regionkey", "c_nationkey", F.col("c_mktsegment") == s).select(F.lit(s).alias("segment"), "estimate", "se", "df")
        out = one if out is None else out.union(one)
    counts = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return intervals.korn_graubard(out.join(counts, "segment"), "estimate", "se", "n", "df")


@plan("""WITH m AS (SELECT l_shipmode AS g, k, count(*) AS m, count(*) FILTER (hit) AS h FROM (SELECT l_linenumber AS l_shipmode, l_suppkey AS k, l_returnflag = 'R' AS hit FROM lineitem) GROUP BY ALL),
a AS (SELECT g, sum(m) AS n, sum(h) AS hits, count(*) AS n_clusters, sum(m) ** 2 / sum(m * m) AS e FROM m GROUP BY g), p AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM a)
SELECT g AS l_linenumber, n::BIGINT AS n, hits::BIGINT AS hits, n_clusters, round(e, 6) AS n_eff, round(((p + z * z / (2 * e)) - z * sqrt(p * (1 - p) / e + z * z / (4 * e * e))) / (1 + z * z / e), 9) AS low,
round(((p + z * z / (2 * e)) + z * sqrt(p * (1 - p) / e + z * z / (4 * e * e))) / (1 + z * z / e), 9) AS high FROM p""")
def clustered_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines by line number, suppliers as clusters."""
    (l,) = read(spark, sf_dir, "lineitem")
    out = intervals.clustered_wilson(l, ["l_linenumber"], F.col("l_returnflag") == "R", "l_suppkey")
    return out.select("l_linenumber", "n", "hits", "n_clusters", F.round("n_eff", 6).alias("n_eff"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@plan("SELECT p_partkey, round(sqrt(least(greatest(p_size * 2 - 5, 0), 100) / 100.0 * (1 - least(greatest(p_size * 2 - 5, 0), 100) / 100.0) / (p_retailprice - 850) * 1e4 + 1 / 12.0), 9) AS sd FROM part")
def rounded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a published whole per cent may be off by."""
    (p,) = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(intervals.rounded_share_sd(F.col("p_size") * 2.0 - 5, F.col("p_retailprice") - 850), 9).alias("sd"))


_TOUCH = f"""s AS ({_NATION_EDGES}), e AS (SELECT *, ax AS px, ay AS py FROM s), pairs AS (SELECT p.k AS a, q.k AS b, p.ax, p.ay, p.bx, p.b_y, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.b_y AS dy FROM e p JOIN e q ON p.k <> q.k),
d AS (SELECT a, b, least({', '.join(f"sqrt(pow({x0} + greatest(0, least(1, (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (pow({x1} - {x0}, 2) + pow({y1} - {y0}, 2)))) * ({x1} - {x0}) - {px}, 2) + pow({y0} + greatest(0, least(1, (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (pow({x1} - {x0}, 2) + pow({y1} - {y0}, 2)))) * ({y1} - {y0}) - {py}, 2))" for x0, y0, x1, y1, px, py in (("ax", "ay", "bx", "b_y", "cx", "cy"), ("ax", "ay", "bx", "b_y", "dx", "dy"), ("cx", "cy", "dx", "dy", "ax", "ay"), ("cx", "cy", "dx", "dy", "bx", "b_y")))}) AS d,
((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx)) < 0 AS crossed FROM pairs),
t AS (SELECT DISTINCT a, b FROM d WHERE crossed OR d <= 1.5)"""


@plan(f"WITH {_TOUCH} SELECT a, b FROM t")
def contiguous_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose areas come within 1.5 of each other."""
    (n,) = read(spark, sf_dir, "nation")
    return moran.contiguous(_nations(n), "n_nationkey", 1.5)


@plan(f"""WITH {_TOUCH}, v AS (SELECT c_nationkey AS k, n_regionkey AS g, avg(c_acctbal) AS x FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey IN (SELECT a FROM t) GROUP BY ALL),
w AS (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS w FROM t WHERE a IN (SELECT k FROM v) AND b IN (SELECT k FROM v)), m AS (SELECT avg(x) AS m FROM v),
o AS (SELECT sum(w * (p.x - m) * (q.x - m)) / (SELECT sum((x - m) ** 2) FROM v, m) AS o FROM w JOIN v p ON p.k = a JOIN v q ON q.k = b, m),
u AS (SELECT d, k, g, x, row_number() OVER (PARTITION BY d, g ORDER BY k) AS i, row_number() OVER (PARTITION BY d, g ORDER BY {_u("'17'", "d", "k")}, k) AS j FROM v, range(99) AS r(d)), x AS (SELECT p.d, p.k, q.x FROM u p JOIN u q ON p.d = q.d AND p.g = q.g AND p.i = q.j),
t2 AS (SELECT p.d, sum(w * (p.x - m) * (q.x - m)) / (SELECT sum((x - m) ** 2) FROM v, m) AS t FROM w JOIN x p ON p.k = a JOIN x q ON q.k = b AND q.d = p.d, m GROUP BY p.d), z AS (SELECT avg(t) AS c, quantile_cont(t, 0.025) AS low, quantile_cont(t, 0.975) AS high, count(*) AS draws FROM t2)
SELECT round(o, 9) AS observed, round(c, 9) AS null_mean, round(low, 9) AS null_low, round(high, 9) AS null_high, round((SELECT count(*) + 1 FROM t2 WHERE abs(t) >= abs(o) - 1e-12) / (draws + 1), 9) AS p,
  round((SELECT count(*) + 1 FROM t2 WHERE abs(t - c) >= abs(o - c) - 1e-12) / (draws + 1), 9) AS p_centre, round(c / o, 9) AS retained, draws FROM z, o""")
def moran_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moran's I of mean balances among nations that touch, against balances dealt anew within regions."""
    c, n = read(spark, sf_dir, "customer", "nation")
    values = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_nationkey").alias("k"), F.col("n_regionkey").alias("g")).agg(F.avg("c_acctbal").alias("x"))
    nulls = moran.moran_null(values, "k", "x", moran.contiguous(_nations(n), "n_nationkey", 1.5), 99, 17, ["g"])
    return _rounded(draws.summary(nulls, "observed"), *_SUMMARY)


@plan("""WITH r AS (SELECT p_retailprice AS y, (p_size % 3 = 0)::INT AS g, p_size::DOUBLE AS x FROM part), m AS (SELECT avg(y) AS my, avg(g) AS mg, avg(x) AS mx, regr_slope(y, x) AS by_, regr_slope(g, x) AS bg, regr_sxx(y, x) AS sxx, count(*) AS n FROM r),
e AS (SELECT y - my - by_ * (x - mx) AS ry, g - mg - bg * (x - mx) AS rg, 1.0 / n + (x - mx) ** 2 / sxx AS h FROM r, m), f AS (SELECT sum(rg * ry) / sum(rg * rg) AS b, sum(rg * rg) AS ss FROM e)
SELECT round(b, 6) AS effect, round(sqrt(sum((rg * (ry - b * rg) / (1 - h - rg * rg / ss)) ** 2)) / ss, 6) AS se, round(b / (sqrt(sum((rg * (ry - b * rg) / (1 - h - rg * rg / ss)) ** 2)) / ss), 5) AS t, count(*) AS n FROM e, f GROUP BY b, ss""")
def adjusted_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of parts whose size is a multiple of three against others at equal size."""
    (p,) = read(spark, sf_dir, "part")
    out = moran.adjusted_effect(p, "p_retailprice", F.col("p_size") % 3 == 0, ["p_size"])
    return out.select(F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"), "n")


@plan("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b,
rank() OVER (ORDER BY length(p_name)) + (count(*) OVER (PARTITION BY length(p_name)) - 1) / 2.0 AS c FROM part), k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc, count(*) AS n FROM r)
SELECT round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 9) AS rho, n FROM k""")
def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return moran.partial_spearman(p.withColumn("l", F.length("p_name")), "p_size", "p_retailprice", "l").withColumn("rho", F.round("rho", 9))


@plan("SELECT o_custkey, min(year(o_orderdate) + (month(o_orderdate) >= 10)::INT)::INT AS first FROM orders GROUP BY 1")
def first_fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fiscal year, from October, in which a customer ordered."""
    (o,) = read(spark, sf_dir, "orders")
    return moran.first_in_period(o, "o_custkey", "o_orderdate", 10)


_FEATURES = {
    "balance": "c_acctbal", "some": "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END", "most": "CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END", "constant": "7", "odd": "c_custkey % 2", "rare": "CASE WHEN c_custkey < 3 THEN 1 ELSE 0 END",
    "never": "CAST(NULL AS DOUBLE)", "code": "c_nationkey",
}


@plan("WITH f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS f, ({e})::DOUBLE AS x FROM customer" for n, e in _FEATURES.items()) + """), s AS (SELECT f, count(*) AS rows, count(x) AS n, count(*) FILTER (x = 1) AS o, count(*) FILTER (x = 0) AS z, min(x) = max(x) AS same FROM f GROUP BY f),
w AS (SELECT f, n, CASE WHEN f = 'code' THEN 'tells the area' WHEN n > 0 AND o + z = n THEN CASE WHEN least(o, z) < 20 THEN 'fewer than 20 rows on one side' END WHEN n < greatest(20, 0.5 * rows) THEN 'observed in fewer than half of the rows' WHEN same THEN 'constant' END AS why FROM s)
SELECT f AS feature, why IS NULL AS included, coalesce(why, '') AS reason, n AS n_observed FROM w""")
def label_free_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which measures of customers may enter a model, with the reason for those that may not."""
    (c,) = read(spark, sf_dir, "customer")
    return selection.label_free_filter(c.select(*[F.expr(e).alias(n) for n, e in _FEATURES.items()]), list(_FEATURES), 20, {"code": "tells the area"})


@plan("""WITH z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, coalesce((CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END - avg(CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END) OVER ()) / stddev_pop(CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END) OVER (), 0) AS b FROM part),
c AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM z), e AS (SELECT *, (aa + bb + sqrt((aa - bb) ** 2 + 4 * ab * ab)) / 2 AS l FROM c), v AS (SELECT *, sqrt(ab * ab + (l - aa) ** 2) AS d FROM e),
s AS (SELECT p_partkey, (a - ma) * ab / d + (b - mb) * (l - aa) / d AS one, (a - ma) * (l - aa) / d - (b - mb) * ab / d AS two, ab, l, aa FROM z, v)
SELECT p_partkey, round(one * CASE WHEN greatest(ab, l - aa) >= greatest(-ab, aa - l) THEN 1 ELSE -1 END, 6) AS pc1, round(two * CASE WHEN greatest(l - aa, -ab) >= greatest(aa - l, ab) THEN 1 ELSE -1 END, 6) AS pc2 FROM s""")
def principal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on the two components of size and price, which some lack."""
    (p,) = read(spark, sf_dir, "part")
    rows = p.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice")).alias("price"))
    scores, _ = selection.principal_scores(rows, "p_partkey", ["p_size", "price"], 2)
    return scores.select("p_partkey", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


_LISTS = ["rich", "new", "old"]


@plan("""WITH RECURSIVE l AS (SELECT c_nationkey AS g, 0 AS c, list(c_custkey ORDER BY c_acctbal DESC, c_custkey) AS l FROM customer WHERE c_acctbal > 5000 GROUP BY 1 UNION ALL SELECT c_nationkey, 1, list(c_custkey ORDER BY c_custkey DESC) FROM customer GROUP BY 1
  UNION ALL SELECT c_nationkey, 2, list(c_custkey ORDER BY c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), g AS (SELECT DISTINCT g FROM l),
r AS (SELECT g, 0 AS t, []::BIGINT[] AS sel, []::INT[] AS via FROM g UNION ALL
  SELECT r.g, t + 1, CASE WHEN len(sel) < 8 AND len(n) > 0 THEN list_append(sel, n[1]) ELSE sel END, CASE WHEN len(sel) < 8 AND len(n) > 0 THEN list_append(via, (t % 3)::INT) ELSE via END
  FROM (SELECT r.*, list_filter(coalesce(l, []), lambda x: NOT list_contains(sel, x)) AS n FROM r LEFT JOIN l ON l.g = r.g AND l.c = r.t % 3 WHERE t < 24) r),
f AS (SELECT g, sel, via FROM r WHERE t = 24) SELECT g AS c_nationkey, unnest(range(1, len(sel) + 1))::INT AS place, unnest(sel) AS c_custkey, ['rich', 'new', 'old'][unnest(via) + 1] AS via FROM f""")
def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight customers of each nation, in turns the richest, the newest and the oldest of a segment."""
    (c,) = read(spark, sf_dir, "customer")
    pick = lambda df, name, rank: df.select("c_nationkey", F.lit(name).alias("list"), "c_custkey", rank.alias("rank"))
    ranked = pick(c.filter("c_acctbal > 5000"), "rich", -F.col("c_acctbal")).union(pick(c, "new", -F.col("c_custkey").cast("double"))).union(pick(c.filter("c_mktsegment = 'BUILDING'"), "old", F.col("c_custkey").cast("double")))
    return selection.interleaved(ranked, ["c_nationkey"], "list", _LISTS, "c_custkey", [F.col("rank"), F.col("c_custkey")], 8)


_SITES = """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN (s_suppkey % 170 - 85)::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 95.0::DOUBLE END AS lat, CASE s_suppkey % 5 WHEN 0 THEN (s_suppkey % 340 - 170)::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 10.0::DOUBLE END AS lon,
CASE s_suppkey % 3 WHEN 0 THEN lpad((s_suppkey % 40)::VARCHAR, 5, '0') WHEN 1 THEN ' ' || lpad((s_suppkey % 60)::VARCHAR, 5, '0') || '-1234' ELSE s_suppkey::VARCHAR END AS zip, 'city' || (s_suppkey % 7) AS city, (s_nationkey % 4)::VARCHAR AS state FROM supplier"""
_ZIPS = "SELECT lpad(n_nationkey::VARCHAR, 5, '0') AS zip5, n_nationkey * 1.5::DOUBLE AS lat, n_nationkey * -2.5::DOUBLE AS lon FROM nation"
_CITIES = "SELECT 'city' || (n_nationkey % 5) AS city, (n_nationkey % 3)::VARCHAR AS state, n_nationkey * 0.5::DOUBLE AS lat, n_nationkey * -0.25::DOUBLE AS lon FROM nation WHERE n_nationkey < 18"


@plan(f"""WITH s AS ({_SITES}), z AS ({_ZIPS}), c AS (SELECT city, state, min(lat) AS lat, min(lon) AS lon FROM ({_CITIES}) GROUP BY ALL HAVING count(*) = 1),
j AS (SELECT s.s_suppkey, s.lat, s.lon, z.lat AS zl, z.lon AS zo, c.lat AS cl, c.lon AS co, coalesce(abs(s.lat) <= 90 AND abs(s.lon) <= 180 AND NOT (s.lat = 0 AND s.lon = 0), false) AS own FROM s LEFT JOIN z ON z.zip5 = CASE WHEN regexp_full_match(trim(zip), '[0-9]{{5}}(-?[0-9]{{4}})?') THEN substr(trim(zip), 1, 5) END LEFT JOIN c USING (city, state))
SELECT s_suppkey, CASE WHEN own THEN lat ELSE coalesce(zl, cl) END AS lat, CASE WHEN own THEN lon ELSE coalesce(zo, co) END AS lon, CASE WHEN own THEN 'site' WHEN zl IS NOT NULL THEN 'zip' WHEN cl IS NOT NULL THEN 'city' ELSE 'not_located' END AS method FROM j""")
def located_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their own points, their ZIPs', or the only place of their city's name."""
    s, n = read(spark, sf_dir, "supplier", "nation")
    s.createOrReplaceTempView("_sites_supplier")
    n.createOrReplaceTempView("_sites_nation")
    sites, zips, cities = (spark.sql(q.replace("::VARCHAR", "::STRING").replace("FROM supplier", "FROM _sites_supplier").replace("FROM nation", "FROM _sites_nation")) for q in (_SITES, _ZIPS, _CITIES))
    return selection.located(sites, zips, cities).select("s_suppkey", "lat", "lon", "method")


@plan("""WITH r AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS code, c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_nationkey NOT IN (3, 5) GROUP BY ALL)
SELECT CASE code WHEN '01' THEN '03' WHEN '02' THEN '05' ELSE code END AS code, segment, n, code AS as_published, CASE code WHEN '01' THEN '01->03' WHEN '02' THEN '02->05' END AS bridge FROM r""")
def bridged_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by nation's code, two of which were renamed."""
    (c,) = read(spark, sf_dir, "customer")
    r = c.filter("c_nationkey NOT IN (3, 5)").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("code"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return selection.bridged(r, "code", {"01": "03", "02": "05"}, ["code", "segment"])
