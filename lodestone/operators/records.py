"""Records and lists: ranks for display, truncation, coverage, priorities, shortage rows, and checks between tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.prefix import running, with_ranges


def competition_rank(df: DataFrame, score: str, eligible: Column, by: list[str], out: str) -> DataFrame:
    """1 for the best eligible score of a group, equal scores share the smallest rank; null otherwise."""
    ok = F.coalesce(eligible, F.lit(False)) & F.col(score).isNotNull()
    rows = df.withColumn("_ok", ok)
    counts = rows.filter("_ok").groupBy(*by, score).agg(F.count("*").alias("_n"))
    above = running(with_ranges(counts, [*by, score]), F.col("_n"), [score], "_run", backward=True, by=by).select(*[F.col(c).alias(f"_of_{c}") for c in [*by, score]], (F.col("_run") - F.col("_n") + 1).alias("_rank"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, score]]
    return rows.join(above, same, "left").select(*df.columns, F.when(F.col("_ok"), F.col("_rank")).alias(out))


def limit_with_record(df: DataFrame, by: list[str], order: list[Column], k: int) -> tuple[DataFrame, DataFrame]:
    """The first k rows of each group, and for each group how many there were, how many are returned, and whether some were cut."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
    record = df.groupBy(*by).agg(F.count("*").alias("total")).select(*by, "total", F.least("total", F.lit(k)).alias("returned"), (F.col("total") > k).alias("truncated"))
    return kept, record


def unstack(df: DataFrame, ids: list[str], level: str, values: list[str], value: str) -> DataFrame:
    """One row for each ids, a column for each of the known values of a level."""
    return df.groupBy(*ids).agg(*[F.sum(F.when(F.col(level) == v, F.col(value))).alias(v) for v in values])


def stack(df: DataFrame, ids: list[str], columns: list[str], level: str, value: str) -> DataFrame:
    """One row for each ids and column, nulls too."""
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias(level), F.col(c).alias(value)) for c in columns])).alias("_s")).select(*ids, "_s.*")


def coverage(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """How many keys are wanted, found among them, missing, and found beyond them."""
    a, b = wanted.select(key).distinct().withColumn("_a", F.lit(1)), found.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(F.count("_a").alias("wanted"), both.alias("matched"), (F.count("_a") - both).alias("missing"), (F.count("_b") - both).alias("extra"), F.try_divide(both, F.count("_a")).alias("share"))


def required_tables(tables: dict[str, DataFrame | None]) -> DataFrame:
    """For each required table whether it is there and has a row; one row of each table is looked at."""
    spark = next(t.sparkSession for t in tables.values() if t is not None)
    out = None
    for name, df in tables.items():
        one = spark.range(1).select(F.lit(name).alias("name"), F.lit(df is not None).alias("there"))
        one = one.withColumn("filled", F.lit(False)) if df is None else one.crossJoin(df.limit(1).agg((F.count("*") > 0).alias("filled")))
        out = one if out is None else out.union(one)
    return out


def column_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that were added or removed."""
    rows = [(c, "added") for c in new.columns if c not in old.columns] + [(c, "removed") for c in old.columns if c not in new.columns]
    return old.sparkSession.createDataFrame(rows, "column string, change string")


def pair_counts_text(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """For each group `left|right:n` of its pairs, sorted and joined by semicolons."""
    n = df.groupBy(*by, left, right).agg(F.count("*").alias("_n"))
    text = F.concat_ws("|", F.col(left), F.col(right))
    return n.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(text, F.lit(":"), F.col("_n").cast("string")))), ";").alias("pairs"))


def rank_by_basis(df: DataFrame, by: list[str], bases: list[tuple[str, Column]], key: str) -> DataFrame:
    """Rank within a group by the first basis that a row has (larger is better), earlier bases before later ones; ties by key."""
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in bases])
    place = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, (_, c) in enumerate(bases)])
    rows = df.withColumn("basis", name).withColumn("_p", F.coalesce(place, F.lit(len(bases)))).withColumn("_v", F.coalesce(*[c.cast("double") for _, c in bases]))
    rows = rows.withColumn("_w", F.coalesce(-F.col("_v"), F.lit(float("inf"))))
    ranked = running(with_ranges(rows, [*by, "_p", "_w", key]), F.lit(1), ["_p", "_w", key], "rank", by=by)
    return ranked.select(*df.columns, "basis", F.col("rank").cast("int").alias("rank"))


def tie_averaged_overlap(df: DataFrame, chance: str, wanted: DataFrame, key: str) -> DataFrame:
    """Expected number of wanted keys among the n best, from each row's chance of being among them."""
    hit = df.join(wanted.select(key).distinct().withColumn("_w", F.lit(1)), key, "left")
    return hit.agg(F.sum(F.when(F.col("_w") == 1, F.col(chance)).otherwise(0.0)).alias("overlap"), F.count_if((F.col(chance) > 0) & (F.col(chance) < 1)).alias("tied"))


def by_priority(df: DataFrame, group: str, source: str, order: list[str], key: str) -> DataFrame:
    """The key that names a group: of its first source in the order given, the smallest key; sources not named come last."""
    place = F.coalesce(*[F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    return df.groupBy(group).agg(F.min(F.struct(place.alias("p"), F.col(source), F.col(key))).alias("_m")).select(group, F.concat_ws(":", f"_m.{source}", f"_m.{key}").alias("canonical"))


def link_rejects(links: DataFrame, group: str, source: str, single: list[str]) -> DataFrame:
    """Groups that hold two records of a source that has one of each entity, by source."""
    n = links.filter(F.col(source).isin(single)).groupBy(group, source).agg(F.count("*").alias("_n")).filter("_n > 1")
    return n.groupBy(source).agg(F.count("*").alias("groups"), F.sum("_n").alias("records"))


def broad_ids(df: DataFrame, ident: str, target: str, most: int) -> DataFrame:
    """Rows without the identifiers that stand for more than `most` targets."""
    few = df.groupBy(ident).agg(F.countDistinct(target).alias("_n")).filter(F.col("_n") <= most)
    return df.join(few.select(ident), ident, "left_semi")


def taxonomy_check(codes: DataFrame, code: str, members: DataFrame, group: str) -> DataFrame:
    """Codes that are in no group or in several, with how many."""
    n = codes.select(code).distinct().join(members.groupBy(code).agg(F.countDistinct(group).alias("_g")), code, "left")
    return n.select(code, F.coalesce("_g", F.lit(0)).alias("groups")).filter("groups <> 1")


def still_inactive(df: DataFrame, ident: str, off: str, on: str) -> DataFrame:
    """Identifiers whose last deactivation no later reactivation has lifted."""
    last = df.groupBy(ident).agg(F.max(off).alias("off"), F.max(on).alias("on"))
    return last.filter(F.col("off").isNotNull() & (F.col("on").isNull() | (F.col("on") < F.col("off"))))


def average_precision(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the precision-recall curve by group: precision at each distinct score times the recall that it adds."""
    at = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_h"), F.count("*").alias("_n"))
    hits = running(with_ranges(at, [*by, score]), F.col("_h"), [score], "_hits", backward=True, by=by)
    run = running(hits, F.col("_n"), [score], "_all", backward=True, by=by)
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.col("_h") * F.col("_hits") / F.col("_all")), F.sum("_h")).alias("ap"))


def first_seen(df: DataFrame, by: str, year: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(year).alias("first"))


def ols_hc3(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope of y on x with its HC3 standard error."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    s = d.agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.regr_slope("_y", "_x").alias("slope"), F.regr_sxx("_y", "_x").alias("sxx"))
    j = d.crossJoin(F.broadcast(s))  # one row
    dx = F.col("_x") - F.col("mx")
    e = F.col("_y") - F.col("my") - F.col("slope") * dx
    h = 1 / F.col("n") + dx * dx / F.col("sxx")
    return j.agg(F.max("slope").alias("slope"), (F.sqrt(F.sum(F.pow(dx * e / (1 - h), 2))) / F.max("sxx")).alias("se"), F.max("n").alias("n"))


def partial_spearman(rho_xy: Column, rho_xz: Column, rho_yz: Column) -> Column:
    return F.try_divide(rho_xy - rho_xz * rho_yz, F.sqrt((1 - rho_xz * rho_xz) * (1 - rho_yz * rho_yz)))
