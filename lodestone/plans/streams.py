"""Streams run once over the events table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.common import ORACLE_SQL, plan, read
from lodestone.plans.series import cusum_alarms, resting_mask  # noqa: F401  their SQL is these streams' too
from lodestone.streaming import stateful, windows


@plan("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.run_once(windows.tumbling(windows.read_stream(spark, f"{sf_dir}/events.parquet"), "ts", ["event_type"], "1 day", "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@plan("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events),
s AS (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.run_once(windows.sessions(windows.read_stream(spark, f"{sf_dir}/events.parquet"), "ts", ["user_id"], "6 hours", "1 day"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@plan("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = windows.deduplicated(windows.read_stream(spark, f"{sf_dir}/events.parquet"), "ts", ["user_id", "event_type"], "365 days")
    return windows.run_once(stream.select("user_id", "event_type"), "append")


def _in_parts(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """The events as four parts by time, each run from the last one's checkpoint, and a last row that lets all that waits out."""
    (e,) = read(spark, sf_dir, "events")
    first, last = e.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = (last - first).days + 1
    part = F.floor(F.datediff(F.to_date("ts"), F.lit(first)) * 4 / days)
    drain = spark.createDataFrame([()], T.StructType([])).select(*[F.expr("TIMESTAMP_NTZ'2200-01-01 00:00:00'").cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema.fields])
    return stateful.run_in_parts(spark, [e.filter(part == k) for k in range(4)], build, drain)


@plan(ORACLE_SQL["cusum_alarms"])
def stream_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _in_parts(spark, sf_dir, lambda s: stateful.cusum_alarms(s, "user_id", "ts", "value", 3600, "2 hours"))
    (e,) = read(spark, sf_dir, "events")
    first = e.agg(F.min(F.unix_date(F.to_date("ts"))).alias("d0"))
    return out.filter("user_id IS NOT NULL").crossJoin(F.broadcast(first)).select("user_id", (F.col("bucket") - F.col("d0") * 24).alias("epoch"), F.round("cusum", 6).alias("cusum"))


@plan(ORACLE_SQL["resting_mask"])
def stream_resting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _in_parts(spark, sf_dir, lambda s: stateful.resting_mask(s, "user_id", "ts", "event_id", F.col("event_type") == "purchase", "5 minutes"))
    return out.filter("user_id IS NOT NULL").select(F.col("row_id").alias("event_id"), "resting")
