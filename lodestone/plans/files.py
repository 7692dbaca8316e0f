"""Files made of the driver's tables and read again."""
from __future__ import annotations

import csv
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.common import plan, read
from lodestone.sources import members

#: Encoding and delimiter of the member of each market segment in a nation's archive.
_FORMS = {"AUTOMOBILE": ("utf-8", ","), "BUILDING": ("utf-16", ";"), "FURNITURE": ("cp1252", "\t"), "HOUSEHOLD": ("utf-8-sig", "|"), "MACHINERY": ("utf-8", ";")}


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """An archive of one nation's customers: a member for each segment, each in its own form, some rows with a cell too many."""
    held: dict[str, list] = {}
    for r in rows.to_pylist():
        held.setdefault(r["c_mktsegment"], []).append(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for segment, own in held.items():
            encoding, delimiter = _FORMS[segment]
            text = io.StringIO()
            w = csv.writer(text, delimiter=delimiter)
            w.writerow(["key", "name", "note", "balance"])
            for r in sorted(own, key=lambda r: r["c_custkey"]):
                w.writerow([r["c_custkey"], r["c_name"], f'says "é{delimiter}"\nhere', "NA" if r["c_custkey"] % 9 == 0 else r["c_acctbal"], *(["extra"] if r["c_custkey"] % 13 == 0 else [])])
            z.writestr(f"{segment.lower()}/customers.csv", text.getvalue().encode(encoding))
    return pa.Table.from_arrays([pa.array([f"nation-{key[0].as_py()}.zip"]), pa.array([out.getvalue()], pa.binary())], ["path", "content"])


@plan("""SELECT 'nation-' || c_nationkey || '.zip' AS file, lower(c_mktsegment) || '/customers.csv' AS member, c_custkey % 13 = 0 AS broken, count(*) AS n, sum(CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END)::BIGINT AS keys,
count(CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 9 <> 0 THEN 1 END) AS balances, round(sum(CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 9 <> 0 THEN c_acctbal END), 2) AS balance, count(CASE WHEN c_custkey % 13 <> 0 THEN 1 END) AS notes FROM customer GROUP BY ALL""")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers packed by nation into archives of tables in five forms, read again without being told which."""
    (c,) = read(spark, sf_dir, "customer")
    archives = c.select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", "c_acctbal").groupBy("c_nationkey").applyInArrow(_packed, "path string, content binary")
    cell = lambda n: F.try_element_at("cells", F.lit(n))
    rows = members.archive_rows(archives).withColumn("broken", F.col("corrupt").isNotNull())
    return rows.groupBy("file", "member", "broken").agg(
        F.count("*").alias("n"), F.sum(cell("key").cast("long")).alias("keys"), F.count(cell("balance")).alias("balances"), F.round(F.sum(cell("balance").cast("double")), 2).alias("balance"),
        F.count(F.when(cell("note").rlike('^says "é.?"\nhere$'), 1)).alias("notes"),
    )
