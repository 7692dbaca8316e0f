"""Choosing features and rows: filters that see no label, principal components, turns among ranked lists, ladders of sources, renamed codes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_free_filter(df: DataFrame, features: list[str], least_side: int, excluded: dict[str, str] | None = None) -> DataFrame:
    """feature, included, reason, n_observed, by rules that see no label: not excluded (feature to reason); a feature of 0 and 1 needs least_side rows of either; any
    other least_side values and values in half of the rows at least, not all equal.  One pass over the rows."""
    excluded = excluded or {}
    stats = [s for i, c in enumerate(features) for s in (
        F.count(c).alias(f"n{i}"), F.count_if(F.col(c) == 1).alias(f"o{i}"), F.count_if(F.col(c) == 0).alias(f"z{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"))]
    one = df.agg(F.count("*").alias("rows"), *stats)

    def row(i: int, c: str) -> Column:
        n, binary = F.col(f"n{i}"), (F.col(f"n{i}") > 0) & (F.col(f"o{i}") + F.col(f"z{i}") == F.col(f"n{i}"))
        side = F.when(F.least(f"o{i}", f"z{i}") < least_side, f"fewer than {least_side} rows on one side")
        wide = F.when(n < F.greatest(F.lit(float(least_side)), 0.5 * F.col("rows")), "observed in fewer than half of the rows").when(F.col(f"l{i}") == F.col(f"h{i}"), "constant")
        why = F.lit(excluded[c]) if c in excluded else F.when(binary, side).otherwise(wide)
        return F.struct(F.lit(c).alias("feature"), why.isNull().alias("included"), F.coalesce(why, F.lit("")).alias("reason"), n.alias("n_observed"))

    return one.select(F.explode(F.array(*[row(i, c) for i, c in enumerate(features)])).alias("r")).select("r.*")


def principal_scores(df: DataFrame, key: str, features: list[str], components: int) -> tuple[DataFrame, DataFrame]:
    """key, pc1, pc2, ..; and component, explained, cumulative: scores on the leading components of the standardised features, missing values at the mean.

    Features that fewer than half of the rows have, or that don't vary, are left out.  Two passes give means and products; the driver solves a matrix of as many rows as features.
    A component's largest loading is positive.
    """
    x = [F.col(c).cast("double") for c in features]
    first = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(x)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    kept = [i for i in range(len(features)) if first["rows"] and 2 * first[f"n{i}"] >= first["rows"] and (first[f"s{i}"] or 0.0) > 0]
    k = min(components, len(kept), max(first["rows"] - 1, 0))
    explained = "component int, explained double, cumulative double"
    if k < 1:
        return df.select(key), df.sparkSession.createDataFrame([], explained)
    z = [F.coalesce((x[i] - first[f"m{i}"]) / first[f"s{i}"], F.lit(0.0)) for i in kept]
    rows = df.select(key, F.array(*z).alias("z"))

    def products(batches):
        total = np.zeros((len(kept), len(kept) + 1))
        for batch in batches:
            if batch.num_rows:
                a = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
                total[:, :-1] += a.T @ a
                total[:, -1] += a.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kept), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "x"])

    sums = np.zeros((len(kept), len(kept) + 1))
    for i, j, v in rows.mapInArrow(products, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x")).collect():  # features squared
        sums[i, j] = v
    mean = sums[:, -1] / first["rows"]  # not quite 0 where values were missing
    cov = sums[:, :-1] / first["rows"] - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    loadings = vectors[:, order]
    loadings = loadings * np.sign(loadings[np.argmax(np.abs(loadings) > np.abs(loadings).max(0) - 1e-9, axis=0), np.arange(k)])
    score = lambda c: sum((F.col("z")[i] - float(mean[i])) * float(loadings[i, c]) for i in range(len(kept)))
    share = np.maximum(values, 0)[order] / np.maximum(values, 0).sum()
    parts = df.sparkSession.createDataFrame([(c + 1, float(share[c]), float(share[: c + 1].sum())) for c in range(k)], explained)
    return rows.select(key, *[score(c).alias(f"pc{c + 1}") for c in range(k)]), parts


def interleaved(ranked: DataFrame, by: list[str], list_name: str, lists: list[str], item: str, order: list[Column], most: int) -> DataFrame:
    """by, place, item, via: in each group the lists take turns, in the order given, each giving its best item that none has given yet, up to `most` items.

    A list gives or passes over at most `most` items, so no more of any are gathered, and a group's fold is of most x lists items at most.
    """
    w = Window.partitionBy(*by, list_name).orderBy(*order)
    top = ranked.filter(F.col(list_name).isin(lists)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    held = top.groupBy(*by, list_name).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(item).alias("i")))).alias("_l"))
    place = F.coalesce(*[F.when(F.col(list_name) == n, F.lit(k)) for k, n in enumerate(lists)])
    group = held.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(place, F.transform("_l", lambda x: x["i"])))).alias("_lists"))
    kind = ranked.schema[item].dataType.simpleString()
    nothing = F.array().cast(f"array<struct<i:{kind},via:int>>")

    def turn(taken: Column, t: Column) -> Column:
        own = F.try_element_at("_lists", t % len(lists))
        fresh = F.get(F.filter(own, lambda i: ~F.exists(taken, lambda x: x["i"] == i)), F.lit(0))
        return F.when(fresh.isNull() | (F.size(taken) >= most), taken).otherwise(F.concat(taken, F.array(F.struct(fresh.alias("i"), (t % len(lists)).cast("int").alias("via")))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(most * len(lists) - 1)), nothing, turn)
    out = group.select(*by, F.posexplode(done).alias("_p", "_x"))
    return out.select(*by, (F.col("_p") + 1).alias("place"), F.col("_x.i").alias(item), F.get(F.array(*[F.lit(n) for n in lists]), F.col("_x.via")).alias("via"))


def zip5(text: Column) -> Column:
    """The five digits of a ZIP or ZIP+4, with or without a hyphen; anything else is null rather than guessed."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(\d{5})(?:-?\d{4})?$", 1), F.lit(""))


def located(sites: DataFrame, zips: DataFrame, cities: DataFrame) -> DataFrame:
    """sites (lat, lon, zip, city, state, ..), zips (zip5, lat, lon), cities (city, state, lat, lon) with lat, lon and method, by the best source that there is: the site's own point,
    its ZIP's, the only place of its city's name in its state; else null and `not_located`.  A point that is out of range or 0, 0 is none."""
    own = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    unique = cities.groupBy("city", "state").agg(F.count("*").alias("_n"), F.first(F.struct("lat", "lon")).alias("_city")).filter("_n = 1").drop("_n")
    points = zips.groupBy("zip5").agg(F.min(F.struct("lat", "lon")).alias("_zip"))
    out = sites.withColumn("zip5", zip5(F.col("zip"))).join(points, "zip5", "left").join(unique, ["city", "state"], "left")
    of = lambda c: F.when(own, F.col(c)).otherwise(F.coalesce(F.col(f"_zip.{c}"), F.col(f"_city.{c}")))
    method = F.when(own, "site").when(F.col("_zip").isNotNull(), "zip").when(F.col("_city").isNotNull(), "city").otherwise("not_located")
    return out.select(*[c for c in sites.columns if c not in ("lat", "lon")], of("lat").alias("lat"), of("lon").alias("lon"), method.alias("method"))


def bridged(df: DataFrame, code: str, renames: dict[str, str], key: list[str]) -> DataFrame:
    """df with codes renamed one to one, as_published and bridge (what was renamed to what; else null); rows that would fall together with others of the same key (which has the code) are an error."""
    if len(set(renames.values())) < len(renames) or set(renames.values()) & set(renames):
        raise ValueError("renames must be one to one and done in one step")
    known = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair]) if renames else F.create_map().cast("map<string,string>")
    out = df.withColumn("as_published", F.col(code)).withColumn(code, F.coalesce(F.try_element_at(known, F.col(code)), F.col(code)))
    out = out.withColumn("bridge", F.when(F.col("as_published") != F.col(code), F.concat_ws("->", "as_published", code)))
    met = out.groupBy(*key).agg(F.count("*").alias("_n"), F.count("bridge").alias("_b"), F.min("as_published").alias("_p")).filter("_n > 1 AND _b > 0")
    first = met.limit(5).collect()
    if first:
        raise ValueError(f"cells collide after the renames: {sorted(r['_p'] for r in first)}")
    return out
