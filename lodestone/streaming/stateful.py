"""State over event time: rows of a participant are taken in the order of their time, whatever the order in which they come.

A row waits in state until the watermark has passed the end of its bucket of time; a timer at the earliest bucket's end then
hands over all buckets that have ended, in order, to a step with what each participant carries on.  Rows whose bucket has already ended are late and left out.  So results
don't depend on micro-batches, and a restart from the checkpoint goes on where the last one ended.  State lives in RocksDB.

A call of a worker to the state costs the same for one row as for thousands, so participants share SHARDS groups by their hash: a group's rows wait as lists, one for
each batch that came, and what its participants carry is written once a batch.
"""
from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lodestone.sources.shared import shared_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of participants; a stream's checkpoint holds for one number only.
SHARDS = 512
#: At most so many state partitions: each starts a worker and opens a store in each micro-batch.
STATE_PARTITIONS = 24


def _plain(column: pd.Series) -> list:
    """Values with None for missing ones."""
    return column.astype(object).where(column.notna(), None).tolist() if column.isna().any() else column.tolist()


class InOrder(StatefulProcessor):
    """Calls step(carries, rows) with the rows of ended buckets; it brings the carries (a tuple for each participant) up to date and returns the rows to give out."""

    def __init__(self, by: str, rows: T.StructType, carry: T.StructType, step: Callable[[dict, pd.DataFrame], pd.DataFrame]):
        self.by, self.rows, self.step = by, rows, step
        lists = lambda fields: T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])
        self.waiting_type, self.carry_type = lists(rows.fields), lists([rows[by], *carry.fields])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_type)
        self.carry = handle.getValueState("carry", self.carry_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        ended = timerValues.getCurrentWatermarkInMs()
        first = None
        for new in rows:
            new = new[new["bucket_end"] > ended]
            if len(new):
                self.waiting.appendValue(self._packed(new))
                at = int(new["bucket_end"].min())
                first = at if first is None else min(first, at)
        if first is not None:
            self._wake(first, ended)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        ended = timerValues.getCurrentWatermarkInMs()
        chunks = list(self.waiting.get())
        every = pd.DataFrame({name: list(itertools.chain.from_iterable(c[i] for c in chunks)) for i, name in enumerate(self.rows.names)})
        due, rest = every[every["bucket_end"] <= ended], every[every["bucket_end"] > ended]
        if not len(due):
            return
        carries = {k: c for k, *c in zip(*self.carry.get(), strict=True)} if self.carry.exists() else {}
        out = self.step(carries, due)
        self.carry.update(tuple(list(x) for x in zip(*((k, *c) for k, c in carries.items()), strict=True)))
        if len(rest):
            self.waiting.put([self._packed(rest)])
            self._wake(int(rest["bucket_end"].min()), ended)
        else:
            self.waiting.clear()
        if len(out):
            yield out

    def _packed(self, rows: pd.DataFrame) -> tuple:
        return tuple(_plain(rows[name]) for name in self.rows.names)

    def _wake(self, at: int, ended: int) -> None:
        """One timer to come, at the earliest end that is waited for; those up to the watermark fire in this batch anyway."""
        ahead = [t for t in self.handle.listTimers() if t > ended]
        if any(t <= at for t in ahead):
            return
        for t in ahead:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, by: str, ts: str, size_s: int, late: str, columns: list[Column], carry: str, step, out: str) -> DataFrame:
    """columns of the stream, in buckets of size_s seconds, through step; out names the columns that step gives beside `by`, with their types."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    end = ((F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(size_s * 1_000_000))) / 1000 + size_s * 1000).cast("long")
    shard = F.when(F.col(by).isNull(), -1).otherwise(F.pmod(F.xxhash64(by), F.lit(SHARDS)).cast("int"))  # nulls apart, so that whole numbers stay such in pandas
    rows = timed.select(shard.alias("_shard"), by, ts, end.alias("bucket_end"), *columns)
    kept = T.StructType([f for f in rows.schema.fields if f.name not in ("_shard", ts)])
    processor = InOrder(by, kept, T.StructType.fromDDL(carry), step)
    schema = T.StructType([T.StructField(by, rows.schema[by].dataType), *T.StructType.fromDDL(out).fields])
    return rows.groupBy("_shard").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def cusum_alarms(stream: DataFrame, by: str, ts: str, value: str, size_s: int, late: str, warm: int = 28, slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """The alarms of timeseries.cusum_alarms as they come: by, bucket (time // size_s), cusum, for sums of value by bucket.

    The first `warm` buckets with a value make a mean and an SD (a null value has no bucket); a constant baseline gives no alarm.
    """

    def step(carries, rows):
        sums = rows.groupby([by, "bucket_end"], sort=True, dropna=False)["value"].sum().reset_index()
        out = []
        for key, end, x in zip(_plain(sums[by]), sums["bucket_end"].tolist(), sums["value"].tolist(), strict=True):
            n, mean, m2, s = carries.get(key, (0, 0.0, 0.0, 0.0))
            if n < warm:
                n += 1
                off = x - mean
                mean += off / n
                m2 += off * (x - mean)
            else:
                sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
                if sd > 0:
                    s = max(0.0, s + (x - mean) / sd - slack)
                    if s > limit:
                        out.append((key, end // (size_s * 1000) - 1, s))
            carries[key] = (n, mean, m2, s)
        return pd.DataFrame(out, columns=[by, "bucket", "cusum"])

    valued = stream.filter(F.col(value).isNotNull() | F.col(by).isNull())
    return _in_order(valued, by, ts, size_s, late, [F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value")], "n int, mean double, m2 double, s double", step, "bucket long, cusum double")


def resting_mask(stream: DataFrame, by: str, ts: str, row_id: str, active: Column, late: str, look_back: int = 10) -> DataFrame:
    """by, row_id, resting: whether no active row of the same participant and day lies in a row's minute or the look_back minutes before it."""

    def step(carries, rows):
        groups = rows.groupby([by, "bucket_end"], sort=True, dropna=False)
        minutes = groups["active"].any().reset_index()
        resting = np.empty(len(minutes), bool)
        for i, (key, end, on) in enumerate(zip(_plain(minutes[by]), minutes["bucket_end"].tolist(), minutes["active"].tolist(), strict=True)):
            (last,) = carries.get(key, (-1,))
            minute = end // 60_000 - 1
            if on:
                last = minute
            resting[i] = last < 0 or minute - last > look_back or last // 1440 != minute // 1440
            carries[key] = (last,)
        return rows[[by, "row_id", "unnamed"]].assign(resting=resting[groups.ngroup().to_numpy()])

    columns = [F.coalesce(F.col(row_id).cast("long"), F.lit(0)).alias("row_id"), F.col(row_id).cast("long").isNull().alias("unnamed"), F.coalesce(active, F.lit(False)).alias("active")]
    given = _in_order(stream, by, ts, 60, late, columns, "last long", step, "row_id long, unnamed boolean, resting boolean")
    return given.select(by, F.when(~F.col("unnamed"), F.col("row_id")).alias("row_id"), "resting")


def run_in_parts(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], drain: DataFrame | None = None) -> DataFrame:
    """Runs a stream over a folder that grows part by part, each run a new start from the last one's checkpoint; returns all rows given out.

    drain is a last part that only moves the watermark on, so that all that waits is given out.  Rows of a micro-batch are written to a folder of its own, so one
    that is run again replaces its rows.  Needs spark.checkpoint.dir outside local mode.
    """
    base = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    partitions = min(STATE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        schema = None
        for part in [*parts, *([drain] if drain is not None else [])]:
            part.write.mode("append").parquet(f"{base}/in")
            stream = build(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
            schema = stream.schema
            query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            query = query.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(f"{base}/out").drop("epoch")
