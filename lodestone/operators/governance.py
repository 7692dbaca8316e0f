"""Contracts and checks on tables; each is one pass of aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import personal_within, sensitive_kind

#: The columns that every written table carries.
PROVENANCE = ["source_name", "source_record_id", "source_version", "retrieved_at", "source_geographic_resolution", "evidence_type", "evidence_level", "provenance_notes", "data_layer"]


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, problems: rows in which a required column is null or blank."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "problems")


def require_provenance(df: DataFrame) -> DataFrame:
    missing = [c for c in PROVENANCE if c not in df.columns]
    if missing:
        raise ValueError(f"missing provenance columns: {', '.join(missing)}")
    return df


def object_id(oid: Column) -> tuple[Column, Column]:
    """namespace and native id of `namespace:native`; nulls for anything else."""
    ok = oid.rlike("^[a-z][a-z0-9_]*:.+$")
    return F.when(ok, F.split_part(oid, F.lit(":"), F.lit(1))).alias("namespace"), F.when(ok, F.substring(oid, F.instr(oid, ":") + 1, F.length(oid))).alias("native")


def contract(df: DataFrame, rules: dict[str, Column], unique: list[str]) -> DataFrame:
    """rule, broken: rows that break each rule (a null breaks it), and repeats of unique columns."""
    names = [*rules, *[f"{u} unique" for u in unique]]
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()], *[(F.count("*") - F.countDistinct(u)).alias(f"{u} unique") for u in unique])
    return one.unpivot([], [F.col(f"`{n}`") for n in names], "rule", "broken")


def count_diff(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    out = None
    for name, (old, new) in tables.items():
        row = old.agg(F.count("*").alias("old_rows")).crossJoin(new.agg(F.count("*").alias("new_rows")))
        row = row.select(F.lit(name).alias("table_name"), "old_rows", "new_rows", (F.col("new_rows") - F.col("old_rows")).alias("delta"))
        out = row if out is None else out.union(row)
    return out


def sensitive_columns(df: DataFrame) -> DataFrame:
    """column, by_name (the kind that its name tells of), refused (values with something that looks personal, in longer words and numbers too), filled: every text column, from one pass."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, by_name string, refused long, filled long")
    one = df.agg(*[F.count_if(personal_within(F.col(c))).alias(f"r{i}") for i, c in enumerate(text)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(text)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(sensitive_kind(c)).alias("by_name"), F.col(f"r{i}").alias("refused"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(text)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
