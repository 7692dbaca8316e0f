"""Reshapes and set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot_present(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Wide slots to rows, blanks and nulls left out."""
    return df.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))


def pivot_unique(df: DataFrame, ids: list[str], column: str, values: list, value: str) -> DataFrame:
    """Rows to columns; a cell that has two rows is an error."""
    if not df.groupBy(*ids, column).count().filter("count > 1").isEmpty():
        raise ValueError(f"{[*ids, column]} is not unique")
    return df.groupBy(*ids).pivot(column, values).agg(F.first(value))


def json_children(df: DataFrame, ids: list[str], column: str, schema: str) -> DataFrame:
    """Fields of a JSON object column; a text that doesn't parse gives nulls."""
    return df.select(*ids, F.from_json(column, schema).alias("_j")).select(*ids, "_j.*")


def common_type(types: list[T.DataType]) -> T.DataType:
    """Least common of long, double, boolean, string; other types stay if all agree, else string."""
    kinds = {t.simpleString() for t in types}
    if len(kinds) == 1:
        return types[0]
    whole = {"tinyint", "smallint", "int", "bigint"}
    if kinds <= whole:
        return T.LongType()
    if kinds <= whole | {"float", "double"}:
        return T.DoubleType()
    return T.StringType()


def union_drift(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name: a missing column is null, a conflicting type goes to the common one."""
    names: dict[str, list[T.DataType]] = {}
    for f in frames:
        for field in f.schema:
            names.setdefault(field.name, []).append(field.dataType)
    kinds = {n: common_type(t) for n, t in names.items()}
    out = None
    for f in frames:
        part = f.select(*[(F.col(n) if n in f.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
        out = part if out is None else out.unionByName(part)
    return out


def set_overlap(members: DataFrame, name: str, item: str) -> DataFrame:
    """a, b, both_n and jaccard of each pair of named sets that share an item.

    Pairs are formed of the names that one item has, so the names must be few; items may be any number.
    """
    sets = members.groupBy(item).agg(F.array_sort(F.collect_set(name)).alias("s"))
    sizes = members.select(name, item).distinct().groupBy(name).agg(F.count("*").alias("n"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    both = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("both_n"))
    a, b = sizes.select(F.col(name).alias("a"), F.col("n").alias("na")), sizes.select(F.col(name).alias("b"), F.col("n").alias("nb"))
    return both.join(a, "a").join(b, "b").select("a", "b", "both_n", (F.col("both_n") / (F.col("na") + F.col("nb") - F.col("both_n"))).alias("jaccard"))
