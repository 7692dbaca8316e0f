"""Places made of the driver's tables: suppliers and customers on a plane, nations as polygons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import places, polygons
from lodestone.plans.common import plan, read

_XY = "(c_custkey * 37 % 1000) / 10.0 AS x, (c_custkey * 53 % 970) / 10.0 AS y"
#: For each nation two parts, as corners from its middle: a five-sided area with a hole, and a triangle apart.  The rings' directions differ.
_RINGS = [
    [(-9.0, -7.0), (8.0, -9.0), (11.0, 3.0), (1.0, 10.0), (-10.0, 4.0)],
    [(-3.0, -2.0), (4.0, -1.5), (1.0, 3.5)],
    [(9.3, 9.1), (12.7, 10.2), (10.1, 13.9)],
]
_MIDDLE = ("(n_nationkey % 5) * 20 + 10.05", "(n_nationkey // 5) * 20 + 10.05")
#: An area of service about each supplier.
_SERVED = [(-3.3, -2.1), (-2.6, 2.9), (3.1, 4.4), (4.2, -3.7)]
_AT = ("(s_suppkey * 41 % 1000) / 10.0", "(s_suppkey * 59 % 970) / 10.0")


def _edges(*rings: list) -> str:
    return ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True))


_NATION_EDGES = f"SELECT n_nationkey AS k, {_MIDDLE[0]} + ax AS ax, {_MIDDLE[1]} + ay AS ay, {_MIDDLE[0]} + bx AS bx, {_MIDDLE[1]} + b_y AS b_y FROM nation, (VALUES {_edges(*_RINGS)}) AS v(ax, ay, bx, b_y)"
_SERVED_EDGES = f"SELECT s_suppkey AS k, {_AT[0]} + ax AS ax, {_AT[1]} + ay AS ay, {_AT[0]} + bx AS bx, {_AT[1]} + b_y AS b_y FROM supplier, (VALUES {_edges(_SERVED)}) AS v(ax, ay, bx, b_y)"


def _ring(x: Column, y: Column, corners: list) -> Column:
    return F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in corners])


def _nations(n: DataFrame) -> DataFrame:
    x, y = F.expr(_MIDDLE[0]).cast("double"), F.expr(_MIDDLE[1].replace("//", "div")).cast("double")
    rings = [_ring(x, y, r) for r in _RINGS]
    return n.select("n_nationkey", F.array(F.array(*rings[:2]), F.array(rings[2])).alias("parts"))


@plan(f"""WITH p AS (SELECT c_custkey, {_XY} FROM customer), e AS ({_NATION_EDGES}),
f AS (SELECT c_custkey, k, x, y, ax, ay, bx, b_y, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t FROM p, e),
j AS (SELECT c_custkey, k, count(*) FILTER ((ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / nullif(b_y - ay, 0) + ax) % 2 = 1 AS inn, min(sqrt(pow(ax + t * (bx - ax) - x, 2) + pow(ay + t * (b_y - ay) - y, 2))) AS d FROM f GROUP BY 1, 2),
b AS (SELECT c_custkey, min({{'o': NOT inn, 'd': CASE WHEN inn THEN 0 ELSE d END, 'n': k}}) AS b FROM j WHERE inn OR d <= 0.7 GROUP BY 1)
SELECT c_custkey, b.n AS n_nationkey, CASE WHEN b IS NULL THEN 'none' WHEN b.o THEN 'snapped' ELSE 'inside' END AS method FROM p LEFT JOIN b USING (c_custkey)""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer", "nation")
    points = c.select("c_custkey", F.expr("(c_custkey * 37 % 1000) / 10.0").cast("double").alias("x"), F.expr("(c_custkey * 53 % 970) / 10.0").cast("double").alias("y"))
    return polygons.points_in_polygons(points, "c_custkey", _nations(n), "n_nationkey", 0.7)


#: Between two successive corners or crossings in x the overlap's height is linear, so its height in the middle tells its area.
@plan(f"""WITH a AS ({_NATION_EDGES}), b AS ({_SERVED_EDGES}),
ba AS (SELECT k, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM a GROUP BY k), bb AS (SELECT k, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM b GROUP BY k),
pairs AS (SELECT ba.k AS i, bb.k AS j, greatest(ba.x0, bb.x0) AS x0, least(ba.x1, bb.x1) AS x1 FROM ba, bb WHERE ba.x0 < bb.x1 AND bb.x0 < ba.x1 AND ba.y0 < bb.y1 AND bb.y0 < ba.y1),
crossing AS (SELECT i, j, a.ax + (a.bx - a.ax) * ((b.ax - a.ax) * (b.b_y - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / nullif((a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax), 0) AS x FROM pairs JOIN a ON a.k = i JOIN b ON b.k = j),
xs AS (SELECT DISTINCT i, j, x::DOUBLE AS x FROM (SELECT i, j, ax AS x FROM pairs JOIN a ON a.k = i UNION ALL SELECT i, j, ax FROM pairs JOIN b ON b.k = j UNION ALL SELECT i, j, x FROM crossing UNION ALL SELECT i, j, x0 FROM pairs UNION ALL SELECT i, j, x1 FROM pairs) JOIN pairs USING (i, j) WHERE x BETWEEN x0 AND x1),
strips AS (SELECT i, j, x, lead(x) OVER (PARTITION BY i, j ORDER BY x) AS nx FROM xs), mids AS (SELECT i, j, (x + nx) / 2 AS m, nx - x AS w FROM strips WHERE nx > x),
ca AS (SELECT i, j, m, w, ay + (b_y - ay) * (m - ax) / (bx - ax) AS y FROM mids JOIN a ON a.k = i AND (ax > m) <> (bx > m)), cb AS (SELECT i, j, m, ay + (b_y - ay) * (m - ax) / (bx - ax) AS y FROM mids JOIN b ON b.k = j AND (ax > m) <> (bx > m)),
ra AS (SELECT *, lead(y) OVER w AS ny, row_number() OVER w AS r FROM ca WINDOW w AS (PARTITION BY i, j, m ORDER BY y)), rb AS (SELECT *, lead(y) OVER w AS ny, row_number() OVER w AS r FROM cb WINDOW w AS (PARTITION BY i, j, m ORDER BY y)),
common AS (SELECT i, j, sum(ra.w * greatest(0, least(ra.ny, rb.ny) - greatest(ra.y, rb.y))) AS area FROM ra JOIN rb USING (i, j, m) WHERE ra.r % 2 = 1 AND rb.r % 2 = 1 GROUP BY i, j)
SELECT i AS n_nationkey, j AS s_suppkey, round(area, 6) AS area, round(area / {{whole}}, 8) AS share_a, round(area / {{served}}, 8) AS share_b FROM common WHERE area > 1e-7""".format(
    whole=sum(w * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2 for w, r in zip((1, -1, 1), _RINGS, strict=True)),
    served=abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(_SERVED, _SERVED[1:] + _SERVED[:1], strict=True))) / 2,
))
def polygon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation's area and each supplier's area of service have in common, and its share of either."""
    n, s = read(spark, sf_dir, "nation", "supplier")
    x, y = (F.expr(e).cast("double") for e in _AT)
    served = s.select("s_suppkey", polygons.polygon(_ring(x, y, _SERVED)).alias("parts"))
    out = polygons.overlaps(_nations(n), "n_nationkey", served, "s_suppkey")
    return out.select("n_nationkey", "s_suppkey", F.round("area", 6).alias("area"), F.round("share_a", 8).alias("share_a"), F.round("share_b", 8).alias("share_b"))


@plan(f"""WITH p AS (SELECT c_custkey, c_nationkey, c_acctbal, {_XY} FROM customer), s AS (SELECT (s_suppkey * 41 % 1000) / 10.0 AS sx, (s_suppkey * 59 % 970) / 10.0 AS sy FROM supplier),
n AS (SELECT p.*, EXISTS (SELECT 1 FROM s WHERE pow(sx - x, 2) + pow(sy - y, 2) <= 9) AS near FROM p)
SELECT c_nationkey, round(sum(c_acctbal), 2) AS population, round(sum(CASE WHEN near THEN c_acctbal ELSE 0 END), 2) AS covered, round(sum(CASE WHEN near THEN c_acctbal ELSE 0 END) / sum(c_acctbal), 9) AS share FROM n GROUP BY 1""")
def reach_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer", "supplier")
    points = c.select("c_custkey", "c_nationkey", "c_acctbal", F.expr("(c_custkey * 37 % 1000) / 10.0").cast("double").alias("x"), F.expr("(c_custkey * 53 % 970) / 10.0").cast("double").alias("y"))
    sites = s.select(F.expr("(s_suppkey * 41 % 1000) / 10.0").cast("double").alias("x"), F.expr("(s_suppkey * 59 % 970) / 10.0").cast("double").alias("y"))
    out = places.reach(points, "c_custkey", "c_nationkey", "c_acctbal", sites, 3.0)
    return out.select("c_nationkey", F.round("population", 2).alias("population"), F.round("covered", 2).alias("covered"), F.round("share", 9).alias("share"))


@plan("""SELECT c_custkey, count(*) OVER (PARTITION BY customer.c_nationkey, c_custkey % 7) - 1 AS others, g AS "groups" FROM customer JOIN (SELECT c_nationkey, c_custkey % 7 AS m, count(DISTINCT c_mktsegment) AS g FROM customer GROUP BY 1, 2) t ON t.c_nationkey = customer.c_nationkey AND t.m = c_custkey % 7""")
def co_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    return places.co_located(c.withColumn("m", F.col("c_custkey") % 7), ["c_nationkey", "m"], "c_custkey", "c_mktsegment")


@plan(f"""WITH p AS (SELECT c_acctbal, {_XY} FROM customer), s AS (SELECT s_suppkey, (s_suppkey * 41 % 1000) / 10.0 AS sx, (s_suppkey * 59 % 970) / 10.0 AS sy FROM supplier)
SELECT s_suppkey, count(x) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS population FROM s LEFT JOIN p ON pow(sx - x, 2) + pow(sy - y, 2) <= 25 GROUP BY 1""")
def population_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer", "supplier")
    p = c.select("c_acctbal", F.expr("(c_custkey * 37 % 1000) / 10.0").cast("double").alias("x"), F.expr("(c_custkey * 53 % 970) / 10.0").cast("double").alias("y"))
    t = s.select("s_suppkey", F.expr("(s_suppkey * 41 % 1000) / 10.0").cast("double").alias("x"), F.expr("(s_suppkey * 59 % 970) / 10.0").cast("double").alias("y"))
    out = places.within(p, "c_acctbal", t, "s_suppkey", 5.0)
    return out.select("s_suppkey", "n", F.round("population", 2).alias("population"))
