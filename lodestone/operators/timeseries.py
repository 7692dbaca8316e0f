"""Minute and day series of participants: grouped aggregates and windows."""
from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_median(df: DataFrame, by: str, ts: str, value: str, out: str) -> DataFrame:
    """Median of positive values of each minute; zero, negative and missing readings are left out."""
    return df.filter(F.col(value) > 0).groupBy(by, F.date_trunc("minute", ts).alias("minute")).agg(F.median(value).alias(out))


def resting_mask(df: DataFrame, by: str, minute: str, active: Column, quiet: int = 10) -> DataFrame:
    """resting: no active minute now or in the last `quiet` minutes of the same day."""
    day = F.to_date(minute)
    stamp = F.hour(minute) * 60 + F.minute(minute)
    w = Window.partitionBy(by, day).orderBy(stamp).rangeBetween(-quiet, 0)
    return df.withColumn("resting", ~F.max(F.coalesce(active, F.lit(False))).over(w))


def spread_interval(df: DataFrame, start: str, end: str, value: str) -> DataFrame:
    """A row for each minute that an interval covers, with an equal share of its value."""
    minutes = F.sequence(F.date_trunc("minute", start), F.date_trunc("minute", end), F.expr("interval 1 minute"))
    spread = df.withColumn("_m", minutes)
    return spread.select(*df.columns, F.explode("_m").alias("minute"), (F.col(value) / F.size("_m")).alias("share"))


def daily_summary(df: DataFrame, by: str, ts: str, value: str, least: int) -> DataFrame:
    """Day totals; the mean is null on a day of fewer than `least` readings."""
    days = df.groupBy(by, F.to_date(ts).alias("day")).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.sum(value).alias("total"))
    return days.select(by, "day", "n", (F.col("n") >= least).alias("valid"), F.when(F.col("n") >= least, F.col("_m")).alias("mean"), "total")


def baseline_deviation(df: DataFrame, by: str, day: str, value: str, reference: Column) -> DataFrame:
    """mu, sd of the days before the reference (a day number), and the deviation of the days from it on."""
    pre = F.when(F.col(day) < reference, F.col(value))
    post = F.when(F.col(day) >= reference, F.col(value))
    return df.groupBy(by).agg(F.avg(pre).alias("mu"), F.stddev_samp(pre).alias("sd"), F.avg(post).alias("after")).withColumn("z", F.try_divide(F.col("after") - F.col("mu"), F.nullif(F.col("sd"), F.lit(0.0))))


def recovery_day(df: DataFrame, by: str, day: str, back: Column) -> DataFrame:
    """First day on which `back` holds, else the last day, censored."""
    return df.groupBy(by).agg(F.coalesce(F.min(F.when(back, F.col(day))), F.max(day)).alias("day"), (~F.coalesce(F.bool_or(back), F.lit(False))).alias("censored"))


def rhythm_stability(df: DataFrame, by: str, epoch: str, value: str, period: int) -> DataFrame:
    """Interdaily stability: variance of the mean profile over total variance."""
    ok = df.filter(F.col(value).isNotNull())
    all_ = ok.groupBy(by).agg(F.var_pop(value).alias("v"), F.avg(value).alias("m"))
    profile = ok.groupBy(by, (F.col(epoch) % period).alias("h")).agg(F.avg(value).alias("p"))
    between = profile.join(all_, by).groupBy(by).agg(F.avg(F.pow(F.col("p") - F.col("m"), 2)).alias("b"), F.max("v").alias("v"))
    return between.select(by, F.try_divide("b", F.nullif(F.col("v"), F.lit(0.0))).alias("stability"))


def rhythm_variability(df: DataFrame, by: str, epoch: str, value: str) -> DataFrame:
    """Intradaily variability: mean squared difference of successive epochs over variance; a pair with a gap or a null is left out."""
    w = Window.partitionBy(by).orderBy(epoch)
    step = df.withColumn("_d", F.when(F.col(epoch) - F.lag(epoch).over(w) == 1, F.col(value) - F.lag(value).over(w)))
    return step.groupBy(by).agg(F.try_divide(F.avg(F.pow("_d", 2)), F.nullif(F.var_pop(value), F.lit(0.0))).alias("variability"))


def extreme_window(df: DataFrame, by: str, slot: str, value: str, period: int, length: int) -> DataFrame:
    """Largest and smallest mean over `length` successive slots of a circular profile, with their starts; ties to the earliest."""
    profile = df.groupBy(by, slot).agg(F.avg(value).alias("_v"))
    twice = profile.union(profile.select(by, (F.col(slot) + period).alias(slot), "_v"))
    w = Window.partitionBy(by).orderBy(slot).rowsBetween(0, length - 1)
    runs = twice.select(by, slot, F.avg("_v").over(w).alias("m"), F.count("_v").over(w).alias("n")).filter((F.col("n") == length) & (F.col(slot) < period))
    best, worst = F.max(F.struct(F.round("m", 9).alias("r"), -F.col(slot), F.col("m"))), F.min(F.struct(F.round("m", 9).alias("r"), F.col(slot).alias("s"), F.col("m")))
    out = runs.groupBy(by).agg(best.alias("_b"), worst.alias("_w"))
    return out.select(by, F.col("_b.m").alias("most"), (-F.col("_b.col2")).alias("most_start"), F.col("_w.m").alias("least"), F.col("_w.s").alias("least_start"))


def bouts(df: DataFrame, by: str, order: str, state: Column, valid: Column) -> DataFrame:
    """Runs of successive valid rows of one state: state, length; an invalid row or a gap in order ends a run."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, order, state.alias("_s"), valid.alias("_v")).filter("_v")
    new = (F.col("_s") != F.lag("_s").over(w)) | (F.col(order) - F.lag(order).over(w) != 1)
    runs = rows.withColumn("_r", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "_r").agg(F.first("_s").alias("state"), F.count("*").alias("length"), F.min(order).alias("start")).drop("_r")


def circular_mean_hours(hour: Column) -> tuple[Column, Column]:
    """Mean direction in [0, 24) and circular standard deviation in hours."""
    a = hour * (2 * pi / 24)
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    r = F.least(F.lit(1.0), F.sqrt(s * s + c * c))
    return F.pmod(F.atan2(s, c) * (24 / (2 * pi)), F.lit(24.0)), F.sqrt(-2 * F.ln(r)) * (24 / (2 * pi))


def rolling_mean(df: DataFrame, by: str, order: str, value: str, half: int, least: int, out: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def cusum_alarms(df: DataFrame, by: str, day: str, value: str, warm: int = 28, slack: float = 0.5, limit: float = 4.0) -> DataFrame:
    """Upper CuSum of each participant against the mean and SD of the first `warm` days; a row for each day over the limit.

    With T the running sum of (x - mean) / SD - slack, the sum that never falls below zero is T less its least value so far
    (0 at the start), so windows do it.  Null values are left out; a series of no more than `warm` days, or a constant
    baseline, gives nothing.
    """
    w = Window.partitionBy(by).orderBy(day)
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(day).cast("long").alias(day), F.col(value).cast("double").alias("_x"), F.row_number().over(w).alias("_i"))
    base = rows.filter(F.col("_i") <= warm).groupBy(by).agg(F.avg("_x").alias("_mu"), F.stddev_samp("_x").alias("_sd")).filter("_sd > 0")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = rows.filter(F.col("_i") > warm).join(base, by).withColumn("_t", F.sum((F.col("_x") - F.col("_mu")) / F.col("_sd") - slack).over(run))
    sums = after.withColumn("cusum", F.col("_t") - F.least(F.lit(0.0), F.min("_t").over(run)))
    return sums.filter(F.col("cusum") > limit).select(by, day, "cusum")


def bridged_runs(df: DataFrame, by: list[str], order: str, on: Column, bridge: int, breaks: Column | None = None) -> DataFrame:
    """df with _run: the number of the run of `on` rows that a row lies in, null outside; and _length, from its first to its last order.

    At most `bridge` successive rows that are off lie between two on ones of a run; a missing order, or a row where `breaks` holds, ends it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    stop = F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)
    rows = df.withColumn("_on", F.coalesce(on, F.lit(False)) & ~stop).withColumn("_stops", F.sum(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_k", F.row_number().over(w))
    before = F.last(F.when(F.col("_on"), F.struct("_k", F.col(order).alias("o"), "_stops")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before)
    new = F.col("_b").isNull() | (F.col("_k") - F.col("_b._k") - 1 > bridge) | (F.col(order) - F.col("_b.o") != F.col("_k") - F.col("_b._k")) | (F.col("_stops") != F.col("_b._stops"))
    rows = rows.withColumn("_r", F.sum(F.when(F.col("_on") & new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "_r")
    last = F.max(F.when(F.col("_on"), F.col(order))).over(inside)
    first = F.min(F.when(F.col("_on"), F.col(order))).over(inside)
    rows = rows.withColumn("_last", last).withColumn("_first", first)
    within = (F.col("_r") > 0) & (F.col(order) <= F.col("_last"))
    return rows.withColumn("_run", F.when(within, F.col("_r"))).withColumn("_length", F.when(within, F.col("_last") - F.col("_first") + 1)).select(*df.columns, "_run", "_length")


def nonwear(df: DataFrame, by: str, minute: str, count: str, length: int = 60, spikes: int = 2) -> DataFrame:
    """Rows with `worn`: false in runs of at least `length` minutes of zeros that hold at most `spikes` successive non-zero minutes at a time; a null count is zero, a missing minute ends a run."""
    runs = bridged_runs(df.select(by, minute, count), [by], minute, F.coalesce(F.col(count), F.lit(0)) == 0, spikes)
    return runs.select(by, minute, count, (~F.coalesce(F.col("_length") >= length, F.lit(False))).alias("worn"))


def bout_minutes(df: DataFrame, by: str, minute: str, active: Column, valid: Column, length: int = 10, pause: int = 2) -> DataFrame:
    """Minutes of each participant in active bouts of at least `length` minutes that hold at most `pause` successive inactive ones; an invalid minute ends a bout."""
    runs = bridged_runs(df, [by], minute, active, pause, ~valid)
    return runs.groupBy(by).agg(F.count_if(F.coalesce(F.col("_length") >= length, F.lit(False))).alias("minutes"))


def main_rest_window(df: DataFrame, by: list[str], minute: str, resting: Column, bridge: int) -> DataFrame:
    """The longest run of resting minutes of each group, gaps of up to `bridge` rows closed; of equal ones the earliest."""
    runs = bridged_runs(df, by, minute, resting, bridge).filter("_run IS NOT NULL").groupBy(*by, "_run").agg(F.min(minute).alias("start"), F.max(minute).alias("end"))
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), -F.col("start"), "start", "end")).alias("_b")
    return runs.groupBy(*by).agg(best).select(*by, "_b.start", "_b.end")


def nearest_event(df: DataFrame, by: str, day: str, events: DataFrame, event_day: str, low: int, high: int) -> DataFrame:
    """Offset of the event day nearest to a row's day among those from `low` to `high` days after it; earlier of equally near ones; null for none."""
    # events of the windows about a row's day lie in the two cells of the row's window, so a long history meets only what is near
    width = high - low + 1
    e = events.select(F.col(by), F.col(event_day).alias("_e")).filter("_e IS NOT NULL").distinct().withColumn("_cell", F.floor(F.col("_e") / width))
    days = df.select(by, day).distinct()
    near = days.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor((F.col(day) + low) / width), F.floor((F.col(day) + high) / width)))))
    gap = F.col("_e") - F.col(day)
    met = near.join(e, [by, "_cell"]).withColumn("_gap", gap).filter(F.col("_gap").between(low, high))
    best = met.groupBy(by, day).agg(F.min_by("_gap", F.struct(F.abs("_gap"), "_gap")).alias("offset"))
    return days.join(best, [by, day], "left")
