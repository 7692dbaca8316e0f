"""Spatial structure over customers, placed by their keys on a part of the earth."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import distances
from lodestone.plans.common import plan, read

_P = "SELECT c_custkey AS k, 25.3 + (c_custkey * 37 % 1009) / 47.0 AS lat, -121.7 + (c_custkey * 53 % 991) / 19.0 AS lon, c_acctbal AS a, (c_custkey * 37 % 1009) + c_custkey * 7919 % 499 AS b FROM customer"
_R = "SELECT k, lat, lon, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p"
_PAIRS = f"""p AS ({_P}), r AS ({_R}), z AS MATERIALIZED (SELECT k, radians(lat) AS la, radians(lon) AS lo, ra - avg(ra) OVER () AS u, rb - avg(rb) OVER () AS v FROM r),
c AS MATERIALIZED (SELECT least(floor(2 * {distances.EARTH_KM} * asin(least(1, sqrt(pow(sin((j.la - i.la) / 2), 2) + cos(i.la) * cos(j.la) * pow(sin((j.lo - i.lo) / 2), 2)))) / 100), 20)::INT AS class, count(*) AS pairs, sum(i.u * j.u) AS su, sum(i.v * j.v) AS sv FROM z i JOIN z j ON i.k <> j.k GROUP BY 1)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k, (25.3 + (k * 37 % 1009) / 47.0).alias("lat"), (-121.7 + (k * 53 % 991) / 19.0).alias("lon"), F.col("c_acctbal").alias("a"), ((k * 37 % 1009) + k * 7919 % 499).alias("b"))


@plan(f"WITH {_PAIRS} SELECT class, pairs::BIGINT AS pairs, round(su / pairs, 4) AS u, round(sv / pairs, 4) AS v FROM c")
def distance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers by hundreds of kilometres, with the mean products of their centred ranks."""
    from lodestone.operators.ranking import mid_rank

    p = mid_rank(mid_rank(_points(spark, sf_dir), "a", "ra"), "b", "rb")
    mean = F.broadcast(p.agg(F.avg("ra").alias("ma"), F.avg("rb").alias("mb")))
    z = p.crossJoin(mean).select(*distances.on_sphere(F.col("lat"), F.col("lon")), (F.col("ra") - F.col("ma")).alias("u"), (F.col("rb") - F.col("mb")).alias("v"))
    out = distances.pair_sums(z, ["u", "v"], 100.0, 2000.0, True)
    return out.select("class", "pairs", F.round(F.col("s_u") / F.col("pairs"), 4).alias("u"), F.round(F.col("s_v") / F.col("pairs"), 4).alias("v"))


@plan(f"""WITH {_PAIRS}, w AS (SELECT count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv FROM z), e AS (SELECT n, uv / sqrt(uu * vv) AS rho, (n + (SELECT sum(su * sv / pairs) FROM c) / ((uu / n) * (vv / n))) / (n * n) AS var FROM w)
SELECT n, round(rho, 9) AS rho, round(CASE WHEN var > 0 THEN least(greatest(1 + 1 / var, 3), n) ELSE n END, 5) AS n_eff FROM e""")
def spatial_effective_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many independent customers the rank correlation of balance and place is worth; its p-value is tested apart."""
    out = distances.effective_n(_points(spark, sf_dir), "a", "b", "lat", "lon")
    return out.select("n", F.round("rho", 9).alias("rho"), F.round("n_eff", 5).alias("n_eff"))
