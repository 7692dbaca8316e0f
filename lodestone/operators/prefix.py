"""Running sums, minima and maxima over a whole order.

What is to be ordered is written once and counted.  Up to SMALL rows are one task's window; more are dealt to ranges of the order, as many as the rows
need, and only one row a range meets the other ranges' rows.  Borders are drawn from the distinct keys by their hashes, so a task that runs again after a lost
executor deals its rows as before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import saved  # noqa: F401  used by other operators too

#: Rows that one task orders; larger orders are cut into ranges of about half as many.
SMALL = 1 << 20
#: At least and at most 2 ** bits ranges; their borders are one array in each task.
LEAST_BITS, MOST_BITS = 6, 16
_FOLD = {"sum": (F.sum, lambda near, far: near + F.coalesce(far, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def with_ranges(df: DataFrame, order: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """df with _range, which grows with the ascending order (nulls first); equal keys share a range, and few rows are one range.

    Borders: of each class of keys by hash, the key with the least second hash.
    """
    df = saved(df, "ordered")
    n = df.count()
    if n <= SMALL:
        out = df.withColumn("_range", F.lit(0))
        out.one_range = True
        return out
    bits = max(LEAST_BITS, min(most_bits, (n // max(1, SMALL // 2)).bit_length()))
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    mixed = F.xxhash64(*order)
    picked = df.groupBy(F.pmod(mixed, F.lit(1 << bits)).alias("_class")).agg(F.min_by(key, F.xxhash64(mixed, F.lit(1))).alias("_key"))
    borders = picked.agg(F.sort_array(F.collect_list("_key")).alias("_borders"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col("_borders"), at + step - 1) <= key, at + step).otherwise(at))
    out = df.crossJoin(F.broadcast(borders)).withColumn("_range", found).drop("_borders")
    out.one_range = False
    return out


def running(ranged: DataFrame, value: Column, order: list[str], out: str, fold: str = "sum", backward: bool = False, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """What with_ranges gave, with value folded over each row and those before it (backward: after it) within `by`.

    order must be unique within `by`, and with_ranges must have had [*by, *order].  total names a column for the fold over all rows.
    The result is ranged as before, so it can run again.
    """
    make, join = _FOLD[fold]
    by = by or []
    keys = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if ranged.one_range:
        upto = group.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = [make("_value").over(upto).alias(out), *([make("_value").over(group).alias(total)] if total else [])]
        done = ranged.withColumn("_value", value).select(*ranged.columns, *columns)
        done.one_range = True
        return done
    near = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_value", value)
    sums = rows.groupBy(*by, "_range").agg(make("_value").alias("_sum"))
    before = group.orderBy(F.col("_range").desc() if backward else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_of_{i}" for i, c in enumerate([*by, "_range"])}
    far = sums.select(*[F.col(c).alias(n) for c, n in names.items()], make("_sum").over(before).alias("_far"), make("_sum").over(group).alias("_total"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    done = rows.withColumn("_near", make("_value").over(near)).join(far if by else F.broadcast(far), same)
    extra = [F.col("_total").alias(total)] if total else []
    done = done.select(*ranged.columns, join(F.col("_near"), F.col("_far")).alias(out), *extra)
    done.one_range = False
    return done
