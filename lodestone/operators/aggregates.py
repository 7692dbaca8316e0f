"""Aggregates beyond the built-in ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.prefix import running, with_ranges


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(w x) / sum(w) over rows where both are there; null without weight."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def sorted_list_text(value: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def mode_smallest(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The most frequent non-null value of each group, ties to the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_m"), F.col(value)))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{value}").alias(out), (-F.col("_b._m")).alias("n"))


def parent_child_sum(df: DataFrame, key: list[str], is_child: str, amount: str, ident: str) -> DataFrame:
    """Repeats by ident removed; of each key the parents' amount where there is one, else the children's."""
    unique = df.groupBy(ident, *key, is_child).agg(F.max(amount).alias("_a"))
    parent, child = F.sum(F.when(~F.col(is_child), F.col("_a"))), F.sum(F.when(F.col(is_child), F.col("_a")))
    return unique.groupBy(*key).agg(F.coalesce(parent, child).alias("total"))


def suppress(df: DataFrame, group: list[str], cell: str, count: str, limit: int) -> DataFrame:
    """Hides counts of 1 to limit; where a group would have exactly one hidden cell, its next smallest is hidden too."""
    small = (F.col(count) >= 1) & (F.col(count) <= limit)
    g = Window.partitionBy(*group)
    order = Window.partitionBy(*group, "_small").orderBy(count, cell)
    out = df.withColumn("_small", small).withColumn("_hidden", F.count_if(F.col("_small")).over(g)).withColumn("_rn", F.row_number().over(order))
    hide = F.col("_small") | ((F.col("_hidden") == 1) & (F.col("_rn") == 1) & (F.col(count) > 0))
    return out.select(*group, cell, F.when(~hide, F.col(count)).alias("shown"), hide.alias("suppressed"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """Linear interpolation at q of the midpoint weighted distribution; beyond its ends the end values.

    Weights are summed by distinct value first.
    """
    sums = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    ranged = with_ranges(sums, [*by, value])
    if not ranged.one_range:  # only the range in which the quantile falls, and those beside it, are ordered
        each = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_s"))
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        each = each.withColumn("_upto", F.sum("_s").over(w.orderBy("_range"))).withColumn("_all", F.sum("_s").over(w)).withColumn("_low", F.col("_upto") - F.col("_s"))
        each = each.withColumn("_hit", ((F.col("_low") <= F.col("_all") * q) & (F.col("_upto") >= F.col("_all") * q)).cast("int"))
        beside = F.max("_hit").over(w.orderBy("_range").rowsBetween(-1, 1)) == 1
        near = each.withColumn("_near", beside).filter("_near").select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_of_range"), "_low", "_all")
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_range") == F.col("_of_range")]
        local = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = ranged.join(F.broadcast(near) if not by else near, same).withColumn("_run", F.col("_low") + F.sum("_w").over(local))
    else:
        rows = running(ranged, F.col("_w"), [value], "_run", by=by, total="_all")
    rows = rows.withColumn("_p", (F.col("_run") - F.col("_w") / 2) / F.col("_all"))
    low = F.max(F.when(F.col("_p") <= q, F.struct(F.col("_p").alias("p"), F.col(value).alias("v"))))
    high = F.min(F.when(F.col("_p") >= q, F.struct(F.col("_p").alias("p"), F.col(value).alias("v"))))
    got = rows.groupBy(*by).agg(low.alias("_l"), high.alias("_h"))
    lerp = F.when(F.col("_l").isNull(), F.col("_h.v")).when(F.col("_h").isNull() | (F.col("_l.p") == F.col("_h.p")), F.col("_l.v")).otherwise(
        F.col("_l.v") + (F.col("_h.v") - F.col("_l.v")) * (q - F.col("_l.p")) / (F.col("_h.p") - F.col("_l.p"))
    )
    return got.select(*by, lerp.alias(out))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of nulls of each column, from one pass."""
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["_all"], columns, "column_name", "nulls").select("column_name", "nulls", F.try_divide("nulls", "_all").alias("null_share"))


def upset_counts(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """How many keys have exactly each pattern of memberships."""
    sets = df.groupBy(key).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    pattern = F.array_join(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in flags])), "&")
    return sets.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


def table_hash(df: DataFrame) -> DataFrame:
    """Rows and an order-independent sum of row hashes (the first 60 bits of each row's md5); nulls count by their place."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]
    lengths = [F.concat(F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.length(m).cast("string")), F.lit(":"), m) for c, m in zip(df.columns, marked, strict=True)]
    digits = F.conv(F.substring(F.md5(F.concat_ws(",", *lengths)), 1, 15), 16, 10)
    return df.select(digits.cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("hash"))


def kish_effective_n(weight: Column) -> Column:
    return F.try_divide(F.pow(F.sum(weight), 2), F.sum(weight * weight))
