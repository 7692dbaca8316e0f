"""Windows and rankings.  Every order ends in a unique key, so that results don't depend on partitioning."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestone.operators.prefix import running, saved, with_ranges


def _mid_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, _rank (average of ties), _all: one row a distinct non-null value, so ties (and a hot value) never meet row by row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = running(with_ranges(counts, [*by, value]), F.col("_n"), [value], "_run", by=by, total="_all")
    return run.select(*by, value, (F.col("_run") - (F.col("_n") - 1) / 2).alias("_rank"), "_all")


def _ranks_of(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """by, _column (place in `values`), _number, _rank, _all of several numeric columns, ordered as one table."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])).alias("_x"))
    long = long.select(*by, F.col("_x.c").alias("_column"), F.col("_x.v").alias("_number"))
    return saved(_mid_ranks(long, "_number", [*by, "_column"]), "ranks")


def percentile_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average-tie rank over the number of non-null values, in (0, 1]; nulls stay null."""
    return percentile_ranks(df, {value: out}, by)


def percentile_ranks(df: DataFrame, outs: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """percentile_rank of several columns (value -> name of its rank), each ranked on df itself."""
    by = by or []
    done = df
    numbers = [v for v in outs if isinstance(df.schema[v].dataType, NumericType)]
    together = _ranks_of(df, numbers, by) if len(numbers) > 1 else None
    for value, out in outs.items():
        if together is not None and value in numbers:
            own = together.filter(F.col("_column") == numbers.index(value)).withColumn(value, F.col("_number").cast(df.schema[value].dataType))
        else:
            own = _mid_ranks(df, value, by)
        done = done.join(own.select(*by, value, (F.col("_rank") / F.col("_all")).alias(out)), [*by, value], "left")
    return done.select(*df.columns, *outs.values())


def mid_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average-tie rank, 1 for the smallest."""
    by = by or []
    return df.join(_mid_ranks(df, value, by).select(*by, value, F.col("_rank").alias(out)), [*by, value], "left").select(*df.columns, out)


def ref_percentile(df: DataFrame, value: str, in_ref: str, out: str) -> DataFrame:
    """Percentile among the reference rows; a row outside them is ranked as if it were added alone."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(in_ref)).alias("_eq"))
    counts = running(with_ranges(counts, [value]), F.col("_eq"), [value], "_run", total="_all").select(value, "_eq", (F.col("_run") - F.col("_eq")).alias("_lt"), "_all")
    inside = (F.col("_lt") + (F.col("_eq") + 1) / 2) / F.col("_all")
    outside = (F.col("_lt") + (F.col("_eq") + 2) / 2) / (F.col("_all") + 1)
    return df.join(counts, value, "left").withColumn(out, F.when(F.col(in_ref), inside).otherwise(outside)).select(*df.columns, out)


def rank_eligible(df: DataFrame, score: str, eligible: Column, key: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """1 for the best score among eligible rows, ties by key; null for rows without a score or not eligible."""
    ok = F.coalesce(eligible, F.lit(False)) & F.col(score).isNotNull()
    rows = df.withColumn("_ok", ok)
    ranked = number_rows(rows.filter("_ok"), F.col(score), key, out, by)
    return ranked.unionByName(rows.filter("NOT _ok").withColumn(out, F.lit(None).cast("long"))).drop("_ok")


def number_rows(df: DataFrame, best: Column, key: list[str], out: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """1 for the row with the largest number `best` (not null), ties by key, which tells rows apart; total names a column for how many there are."""
    by = by or []
    ranged = with_ranges(df.withColumn("_worst", -best), [*by, "_worst", *key])
    return running(ranged, F.lit(1), ["_worst", *key], out, by=by, total=total).drop("_worst", "_range")


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def cap_per_group(df: DataFrame, inner: list[str], inner_cap: int, outer: list[str], outer_cap: int, order: list[Column]) -> DataFrame:
    """At most inner_cap rows of an inner group, then at most outer_cap of an outer one, best first."""
    first = top_k_per_group(df, inner, order, inner_cap, "inner_rn")
    return top_k_per_group(first, outer, order, outer_cap, "outer_rn")


def latest_per_group(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the row with the largest order; a partial aggregate, no sort of the group."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def dense_code(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based code of a value in sorted order."""
    codes = running(with_ranges(df.select(column).distinct(), [column]), F.lit(1), [column], "_run").select(column, (F.col("_run") - 1).alias(out))
    return df.join(codes, column)


def mutual_best(edges: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Edges that are the best of both their ends; ties by the other end's id."""
    a = Window.partitionBy(left).orderBy(F.col(score).desc(), right)
    b = Window.partitionBy(right).orderBy(F.col(score).desc(), left)
    return edges.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b)).filter("_a = 1 AND _b = 1").drop("_a", "_b")


def topn_inclusion(df: DataFrame, score: str, n: int, out: str) -> DataFrame:
    """Chance of being among the n best when ties at the border share the places left."""
    counts = df.groupBy(score).agg(F.count("*").alias("_n"))
    counts = running(with_ranges(counts, [score]), F.col("_n"), [score], "_run", backward=True).withColumn("_above", F.col("_run") - F.col("_n"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - F.col("_above")) / F.col("_n")))
    return df.join(counts.select(score, share.alias(out)), score).select(*df.columns, out)


def islands(df: DataFrame, by: list[str], order: list[str], gap: Column, out: str) -> DataFrame:
    """Numbers runs: gap is true where a new one begins (it may use lag over the same order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_gap", gap.cast("int")).withColumn(out, F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_gap")


def forward_fill(df: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def permute_within(df: DataFrame, by: list[str], key: str, value: str, seed: int, out: str) -> DataFrame:
    """Shuffles a column's values within groups, by a seeded hash of the key."""
    stable = Window.partitionBy(*by).orderBy(key)
    mixed = Window.partitionBy(*by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    left = df.withColumn("_rn", F.row_number().over(stable))
    right = df.select(*by, F.col(value).alias(out), F.row_number().over(mixed).alias("_rn"))
    return left.join(right, [*by, "_rn"]).drop("_rn")
