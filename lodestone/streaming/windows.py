"""Structured Streaming: tumbling windows, sessions and deduplication, each run once over what is there."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_dir


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over one Parquet table (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)


def tumbling(events: DataFrame, ts: str, keys: list[str], size: str, late: str) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), *keys, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicates(keys)


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result table; state and checkpoints go to the session's checkpoint folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(
        lambda df, epoch: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    ).start()
    query.awaitTermination()
    return spark.read.parquet(out)
