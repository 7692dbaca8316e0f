"""Small-area estimates on the driver's tables: orders stand for people, nations for states, suppliers for areas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import smallarea
from lodestone.plans.common import plan, read
from lodestone.plans.resampling import _u

_ROUNDS = 6


def _raked_sql() -> str:
    steps = []
    for r in range(_ROUNDS):
        steps += [
            f"a{r} AS (SELECT n, s, p, ts, tp, CASE WHEN t > 0 THEN w * ts / t ELSE 0 END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY n, s) AS t FROM {f'b{r - 1}' if r else 'm'}))",
            f"b{r} AS (SELECT n, s, p, ts, tp, CASE WHEN t > 0 THEN w * tp / t ELSE 0 END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY n, p) AS t FROM a{r}))",
        ]
    return f"""WITH o AS (SELECT c_nationkey AS n, c_mktsegment AS s, o_orderpriority AS p, count(*) AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
g AS (SELECT n, s, p, coalesce(k, 0) AS k FROM (SELECT * FROM (SELECT DISTINCT n FROM o), (SELECT DISTINCT s FROM o), (SELECT DISTINCT p FROM o)) x LEFT JOIN o USING (n, s, p)),
h AS (SELECT *, sum(k) OVER (PARTITION BY n, s) AS ns, sum(k) OVER (PARTITION BY p) / sum(k) OVER () AS ps FROM g), d AS (SELECT n, s, p, CASE WHEN ns > 0 THEN k / ns ELSE ps END AS w FROM h),
ts AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*)::DOUBLE AS ts FROM customer GROUP BY ALL), tn AS (SELECT n, sum(ts) AS t FROM ts GROUP BY n),
tp AS (SELECT n, p, sum(k) / sum(sum(k)) OVER (PARTITION BY n) * t AS tp FROM g JOIN tn USING (n) GROUP BY n, p, t), m AS (SELECT n, s, p, w::DOUBLE AS w, coalesce(ts, 0) AS ts, coalesce(tp, 0) AS tp FROM d LEFT JOIN ts USING (n, s) LEFT JOIN tp USING (n, p)), {', '.join(steps)}
SELECT n AS nation, s AS segment, p AS priority, round(w, 7) AS people FROM b{_ROUNDS - 1}"""


def _poststrat(spark: SparkSession, sf_dir: str, rounds: int | None) -> tuple[DataFrame, list]:
    c, o = read(spark, sf_dir, "customer", "orders")
    counts = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("k"))
    cells = smallarea.dense(counts, ["nation", "segment", "priority"]).join(counts, ["nation", "segment", "priority"], "left").fillna(0, ["k"])
    seed = smallarea.shares(cells, ["nation", "segment"], ["priority"], "k", "people").select("nation", "segment", "priority", "people")
    by_segment = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    of_nation = by_segment.groupBy("nation").agg(F.sum("n").alias("t"))
    by_priority = smallarea.shares(cells.groupBy("nation", "priority").agg(F.sum("k").alias("k")), ["nation"], ["priority"], "k", "share").join(of_nation, "nation").select("nation", "priority", (F.col("share") * F.col("t")).alias("n"))
    margins = [(["nation", "segment"], by_segment, "n"), (["nation", "priority"], by_priority, "n")]
    return smallarea.raked(seed, "people", margins, rounds or _ROUNDS, ["nation"]), margins


@plan(_raked_sql())
def post_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, segment and order priority, from the two tables of two of them."""
    return _poststrat(spark, sf_dir, None)[0].withColumn("people", F.round("people", 7))


_SIGMA2, _STEPS, _DRAWS = 0.05, 8, 40
_CELLS = "SELECT s_nationkey AS g, s_suppkey AS a, (l_discount > 0.05)::INT AS x, count(*) FILTER (l_returnflag = 'R') AS y, count(*)::DOUBLE AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"


def _fit_sql() -> str:
    """Newton's steps for a constant and one column, the groups eliminated by hand."""
    out = [f"cells AS MATERIALIZED ({_CELLS})", "k AS MATERIALIZED (SELECT g, x, sum(y) AS y, sum(n) AS n FROM cells GROUP BY ALL)", "b0 AS (SELECT ln(sum(y) / (sum(n) - sum(y))) AS b0, 0.0::DOUBLE AS b1 FROM k)", "u0 AS (SELECT DISTINCT g, 0.0::DOUBLE AS u FROM k)"]
    for i in range(_STEPS):
        out += [
            f"e{i} AS (SELECT g, x, y, n, u, 1 / (1 + exp(-(b0 + b1 * x + u))) AS mu FROM k JOIN u{i} USING (g), b{i})",
            f"g{i} AS MATERIALIZED (SELECT g, u, sum(y - n * mu) AS r, sum(x * (y - n * mu)) AS r1, sum(n * mu * (1 - mu)) AS v, sum(x * n * mu * (1 - mu)) AS v1, sum(x * x * n * mu * (1 - mu)) AS v11, sum(n * mu * (1 - mu)) + {1 / _SIGMA2} AS h, sum(y - n * mu) - u / {_SIGMA2} AS ru FROM e{i} GROUP BY g, u)",
            f"s{i} AS MATERIALIZED (SELECT sum(v - v * v / h) AS h00, sum(v1 - v * v1 / h) AS h01, sum(v11 - v1 * v1 / h) AS h11, sum(r - v * ru / h) AS q0, sum(r1 - v1 * ru / h) AS q1 FROM g{i})",
            f"d{i} AS MATERIALIZED (SELECT (h11 * q0 - h01 * q1) / (h00 * h11 - h01 * h01) AS d0, (h00 * q1 - h01 * q0) / (h00 * h11 - h01 * h01) AS d1 FROM s{i})",
            f"b{i + 1} AS MATERIALIZED (SELECT b0 + d0 AS b0, b1 + d1 AS b1 FROM b{i}, d{i})", f"u{i + 1} AS MATERIALIZED (SELECT g, u + (ru - v * d0 - v1 * d1) / h AS u FROM g{i}, d{i})",
        ]
    return ",\n".join(out)


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[smallarea.Fit, DataFrame]:
    l, s = read(spark, sf_dir, "lineitem", "supplier")
    cells = l.join(s, l.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "s_suppkey", (F.col("l_discount") > 0.05).cast("int").alias("x")).agg(F.count_if(F.col("l_returnflag") == "R").alias("y"), F.count("*").alias("n")).withColumn("one", F.lit(1.0))
    return smallarea.random_intercepts(cells, ["one", "x"], "y", "n", "s_nationkey", _SIGMA2), cells


@plan(f"WITH {_fit_sql()} SELECT g AS s_nationkey, round(u, 6) AS u, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM u{_STEPS}, b{_STEPS}")
def random_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a returned line by discount, with an intercept for each supplier's nation."""
    fit, _ = _fitted(spark, sf_dir)
    return fit.groups.select("s_nationkey", F.round("u", 6).alias("u"), *[F.round(F.lit(float(b)), 6).alias(f"b{j}") for j, b in enumerate(fit.beta)])


def _z(*parts: str) -> str:
    u = [f"(({_u(*parts, repr(str(k)))}) + 0.5::DOUBLE) / 281474976710656" for k in (1, 2)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * ({u[1]}))"


@plan(f"""WITH {_fit_sql()}, cov AS (SELECT h11 / (h00 * h11 - h01 * h01) AS c00, -h01 / (h00 * h11 - h01 * h01) AS c01, h00 / (h00 * h11 - h01 * h01) AS c11 FROM s{_STEPS - 1}),
z AS (SELECT d, {_z("'21'", "d", "'one'")} AS z0, {_z("'21'", "d", "'x'")} AS z1 FROM range({_DRAWS}) AS t(d)), sh AS (SELECT d, sqrt(c00) * z0 AS s0, c01 / sqrt(c00) * z0 + sqrt(c11 - c01 * c01 / c00) * z1 AS s1 FROM z, cov),
iu AS (SELECT d, u.g, b0 + s0 AS b0, b1 + s1 AS b1, u.u - (v * s0 + v1 * s1) / h + {_z("'21'", "d", "u.g")} / sqrt(h) AS u FROM sh, b{_STEPS}, u{_STEPS} u JOIN g{_STEPS - 1} g ON g.g = u.g),
r AS (SELECT a, d, sum(n / (1 + exp(-(b0 + b1 * x + u)))) / sum(n) AS rate, sum(n) AS people FROM cells JOIN iu USING (g) GROUP BY a, d)
SELECT a AS s_suppkey, round(avg(rate), 6) AS mean, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high, max(people) AS people FROM r GROUP BY a""")
def area_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's rate of returned lines for each supplier with an interval of its draws."""
    fit, cells = _fitted(spark, sf_dir)
    out = smallarea.summarised(smallarea.area_draws(fit, cells, "s_suppkey", "s_nationkey", "n", _DRAWS, 21), ["s_suppkey"])
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "people")
