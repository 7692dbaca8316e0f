"""Time series on the events table: user_id is the participant, ts the time."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import timeseries as T
from lodestone.plans.common import plan, read


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")[0]


@plan("SELECT user_id, date_trunc('minute', ts) AS minute, round(median(value), 6) AS v FROM events WHERE value > 0 GROUP BY 1, 2")
def minute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.minute_median(_events(spark, sf_dir), "user_id", "ts", "value", "v")
    return out.select("user_id", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("v", 6).alias("v"))


@plan("""WITH e AS (SELECT event_id, user_id, ts::DATE AS d, hour(ts) * 60 + minute(ts) AS m, event_type = 'purchase' AS a FROM events)
SELECT event_id, NOT max(a) OVER (PARTITION BY user_id, d ORDER BY m RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS resting FROM e""")
def resting_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resting_mask(_events(spark, sf_dir), "user_id", "ts", F.col("event_type") == "purchase").select("event_id", "resting")


@plan("SELECT user_id, ts::DATE AS day, count(value) AS n, count(value) >= 3 AS valid, round(CASE WHEN count(value) >= 3 THEN avg(value) END, 6) AS mean, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.daily_summary(_events(spark, sf_dir), "user_id", "ts", "value", 3).select("user_id", "day", "n", "valid", F.round("mean", 6).alias("mean"), F.round("total", 6).alias("total"))


_DAY = "datediff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    first = e.agg(F.min(F.to_date("ts")).alias("d0"))
    return e.crossJoin(F.broadcast(first)).withColumn("day", F.datediff(F.to_date("ts"), "d0"))


@plan(f"""WITH e AS (SELECT user_id, {_DAY} AS day, value FROM events), a AS (SELECT user_id, avg(value) FILTER (day < 15) AS mu, stddev_samp(value) FILTER (day < 15) AS sd, avg(value) FILTER (day >= 15) AS after FROM e GROUP BY 1)
SELECT user_id, round(mu, 6) AS mu, round(sd, 6) AS sd, round((after - mu) / nullif(sd, 0), 6) AS z FROM a""")
def baseline_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.baseline_deviation(_days(spark, sf_dir), "user_id", "day", "value", F.lit(15))
    return out.select("user_id", F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"), F.round("z", 6).alias("z"))


@plan(f"""WITH e AS (SELECT user_id, {_DAY} AS day, avg(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, coalesce(min(day) FILTER (v < 20), max(day))::INT AS day, NOT coalesce(bool_or(v < 20), false) AS censored FROM e GROUP BY 1""")
def recovery_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("value").alias("v"))
    return T.recovery_day(days, "user_id", "day", F.col("v") < 20)


_HOUR = f"SELECT user_id, {_DAY} * 24 + hour(ts) AS epoch, avg(value) AS x FROM events GROUP BY 1, 2"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).groupBy("user_id", (F.col("day") * 24 + F.hour("ts")).alias("epoch")).agg(F.avg("value").alias("x"))


@plan(f"""WITH h AS ({_HOUR}), a AS (SELECT user_id, var_pop(x) AS v, avg(x) AS m FROM h GROUP BY 1), p AS (SELECT user_id, epoch % 24 AS hh, avg(x) AS p FROM h GROUP BY 1, 2),
s AS (SELECT user_id, avg((p - m) ** 2) / nullif(max(v), 0) AS stability FROM p JOIN a USING (user_id) GROUP BY 1),
d AS (SELECT user_id, x, CASE WHEN epoch - lag(epoch) OVER w = 1 THEN x - lag(x) OVER w END AS d FROM h WINDOW w AS (PARTITION BY user_id ORDER BY epoch)),
v AS (SELECT user_id, avg(d * d) / nullif(var_pop(x), 0) AS variability FROM d GROUP BY 1) SELECT user_id, round(stability, 6) AS stability, round(variability, 6) AS variability FROM s JOIN v USING (user_id)""")
def is_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hours(spark, sf_dir)
    out = T.rhythm_stability(h, "user_id", "epoch", "x", 24).join(T.rhythm_variability(h, "user_id", "epoch", "x"), "user_id")
    return out.select("user_id", F.round("stability", 6).alias("stability"), F.round("variability", 6).alias("variability"))


@plan("""WITH p AS (SELECT user_id % 10 AS g, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2), t AS (SELECT * FROM p UNION ALL SELECT g, h + 24, v FROM p),
r AS (SELECT g, h, avg(v) OVER (PARTITION BY g ORDER BY h ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(v) OVER (PARTITION BY g ORDER BY h ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM t)
SELECT g, round(max(m), 6) AS most, arg_max(h, {'a': round(m, 9), 'b': -h})::INT AS most_start, round(min(m), 6) AS least, arg_min(h, {'a': round(m, 9), 'b': h})::INT AS least_start FROM r WHERE n = 10 AND h < 24 GROUP BY 1""")
def m10_l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("g"), F.hour("ts").alias("h"), "value")
    out = T.extreme_window(e, "g", "h", "value", 24, 10)
    return out.select("g", F.round("most", 6).alias("most"), "most_start", F.round("least", 6).alias("least"), "least_start")


@plan("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value > 50 AS s, event_type <> 'error' AS v FROM events),
f AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER w AND i - lag(i) OVER w = 1 THEN 0 ELSE 1 END AS g FROM e WHERE v WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f), b AS (SELECT user_id, run, any_value(s) AS s, count(*) AS n FROM r GROUP BY 1, 2)
SELECT user_id, s AS state, count(*) AS n_bouts, max(n) AS longest, round(1 / avg(n), 6) AS leave_rate FROM b GROUP BY 1, 2""")
def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = _events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    b = T.bouts(e, "user_id", "i", F.col("value") > 50, F.col("event_type") != "error")
    return b.groupBy("user_id", "state").agg(F.count("*").alias("n_bouts"), F.max("length").alias("longest"), F.round(1 / F.avg("length"), 6).alias("leave_rate"))


@plan("""WITH a AS (SELECT event_type, avg(sin(h * 2 * pi() / 24)) AS s, avg(cos(h * 2 * pi() / 24)) AS c FROM (SELECT event_type, hour(ts) + minute(ts) / 60.0 AS h FROM events) GROUP BY 1)
SELECT event_type, round(atan2(s, c) * 24 / (2 * pi()) + CASE WHEN atan2(s, c) < 0 THEN 24 ELSE 0 END, 6) AS mean_hour, round(sqrt(-2 * ln(least(1.0, sqrt(s * s + c * c)))) * 24 / (2 * pi()), 6) AS sd_hours FROM a""")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, sd = T.circular_mean_hours(F.hour("ts") + F.minute("ts") / 60.0)
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(mean, 6).alias("mean_hour"), F.round(sd, 6).alias("sd_hours"))


@plan(f"""WITH d AS (SELECT user_id, {_DAY} AS day, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, day::INT AS day, round(CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END, 6) AS smooth FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _days(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("value").alias("v"))
    return T.rolling_mean(d, "user_id", "day", "v", 2, 3, "smooth").select("user_id", "day", F.round("smooth", 6).alias("smooth"))


@plan("""WITH i AS (SELECT user_id, event_id, date_trunc('minute', ts) AS a, value FROM events WHERE event_type = 'purchase')
SELECT event_id, a + to_minutes(k) AS minute, round(value / 3, 6) AS share FROM i, (SELECT unnest([0, 1, 2]) AS k)""")
def spread_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 2 minutes")).alias("b"), "value")
    out = T.spread_interval(e, "a", "b", "value")
    return out.select("event_id", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("share", 6).alias("share"))


@plan("""WITH d AS (SELECT min(ts)::DATE AS d0 FROM events), h AS (SELECT user_id, datediff('day', d0, ts::DATE) * 24 + hour(ts) AS epoch, sum(value) AS x FROM events, d GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS i FROM h), b AS (SELECT user_id, avg(x) AS mu, stddev_samp(x) AS sd FROM i WHERE i <= 28 GROUP BY 1),
s AS (WITH RECURSIVE r AS (SELECT user_id, 28 AS i, 0.0::DOUBLE AS s, NULL::BIGINT AS epoch FROM b WHERE sd > 0
  UNION ALL SELECT r.user_id, i.i, greatest(0.0, r.s + (i.x - b.mu) / b.sd - 0.5), i.epoch FROM r JOIN i ON i.user_id = r.user_id AND i.i = r.i + 1 JOIN b ON b.user_id = r.user_id) SELECT * FROM r)
SELECT user_id, epoch, round(s, 6) AS cusum FROM s WHERE s > 4 AND epoch IS NOT NULL""")
def cusum_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _days(spark, sf_dir).groupBy("user_id", (F.col("day").cast("long") * 24 + F.hour("ts")).alias("epoch")).agg(F.sum("value").alias("x"))
    return T.cusum_alarms(hours, "user_id", "epoch", "x").withColumn("cusum", F.round("cusum", 6))


_GRID = f"""e AS (SELECT user_id, {_DAY} * 24 + hour(ts) AS minute, sum(CASE WHEN value > 60 THEN floor(value)::BIGINT ELSE 0 END)::BIGINT AS n FROM events GROUP BY 1, 2),
z AS (SELECT user_id, minute, lead(minute) OVER (PARTITION BY user_id ORDER BY minute) AS nxt FROM e WHERE n = 0),
g AS (SELECT user_id, minute, nxt, (SELECT count(*) FROM e WHERE e.user_id = z.user_id AND e.minute > z.minute AND e.minute < z.nxt) AS off FROM z),
l AS (SELECT user_id, minute, nxt IS NOT NULL AND off <= 2 AND off = nxt - minute - 1 AS joined FROM g),
r AS (SELECT user_id, minute, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY minute) AS run FROM (SELECT user_id, minute, coalesce(lag(joined) OVER (PARTITION BY user_id ORDER BY minute), false) AS j FROM l)),
s AS (SELECT user_id, run, min(minute) AS a, max(minute) AS b FROM r GROUP BY 1, 2)"""


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _days(spark, sf_dir).select("user_id", (F.col("day").cast("long") * 24 + F.hour("ts")).alias("minute"), F.when(F.col("value") > 60, F.floor("value")).otherwise(0).cast("long").alias("n"))
    return e.groupBy("user_id", "minute").agg(F.sum("n").alias("n"))


@plan(f"""WITH {_GRID}, w AS (SELECT e.user_id, NOT coalesce(bool_or(s.b - s.a + 1 >= 3), false) AS worn FROM e LEFT JOIN s ON s.user_id = e.user_id AND e.minute BETWEEN s.a AND s.b GROUP BY e.user_id, e.minute)
SELECT user_id, count(*) FILTER (worn) AS worn, count(*) FILTER (NOT worn) AS not_worn FROM w GROUP BY 1""")
def nonwear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' hours stand for minutes; a run of three is enough here."""
    out = T.nonwear(_hourly(spark, sf_dir), "user_id", "minute", "n", 3, 2)
    return out.groupBy("user_id").agg(F.count_if("worn").alias("worn"), F.count_if(~F.col("worn")).alias("not_worn"))


@plan(f"""WITH {_GRID}, m AS (SELECT user_id, max(b - a) AS n FROM s GROUP BY 1) SELECT s.user_id, min(a) AS start, min_by(b, a) AS "end" FROM s JOIN m ON m.user_id = s.user_id AND s.b - s.a = m.n GROUP BY 1""")
def main_rest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.main_rest_window(_hourly(spark, sf_dir), ["user_id"], "minute", F.col("n") == 0, 2)


@plan(f"""WITH {_GRID}, w AS (SELECT e.user_id, coalesce(bool_or(s.b - s.a + 1 >= 2), false) AS bout FROM e LEFT JOIN s ON s.user_id = e.user_id AND e.minute BETWEEN s.a AND s.b GROUP BY e.user_id, e.minute) SELECT user_id, count(*) FILTER (bout) AS minutes FROM w GROUP BY 1""")
def bout_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bout_minutes(_hourly(spark, sf_dir), "user_id", "minute", F.col("n") == 0, F.lit(True), 2, 2)


@plan(f"""WITH e AS (SELECT user_id, {_DAY} AS day, event_type FROM events), p AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase'), q AS (SELECT DISTINCT user_id, day AS eday FROM e WHERE event_type = 'click'),
j AS (SELECT p.user_id, p.day, eday - day AS gap FROM p LEFT JOIN q ON q.user_id = p.user_id AND eday - day BETWEEN -14 AND 7) SELECT user_id, day, arg_min(gap, abs(gap) * 100 + gap) AS "offset" FROM j GROUP BY 1, 2""")
def nearest_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _days(spark, sf_dir).select("user_id", F.col("day").cast("long").alias("day"), "event_type")
    p, q = e.filter("event_type = 'purchase'").select("user_id", "day").distinct(), e.filter("event_type = 'click'").select("user_id", F.col("day").alias("eday")).distinct()
    return T.nearest_event(p, "user_id", "day", q, "eday", -14, 7)
