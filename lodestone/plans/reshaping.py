"""Reshapes and set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import reshape
from lodestone.plans.common import plan, read


@plan("""SELECT p_partkey, slot, code FROM (UNPIVOT (SELECT p_partkey, p_brand AS s1, p_type AS s2, CASE WHEN p_size > 25 THEN p_name END AS s3 FROM part) ON s1, s2, s3 INTO NAME slot VALUE code)""")
def unpivot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    wide = p.select("p_partkey", F.col("p_brand").alias("s1"), F.col("p_type").alias("s2"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("s3"))
    return reshape.unpivot_present(wide, ["p_partkey"], ["s1", "s2", "s3"], "slot", "code")


@plan("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1""")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    out = e.groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.sum("value"))
    return out.select("user_id", F.round("click", 4).alias("click"), F.round("purchase", 4).alias("purchase"))


@plan("""SELECT label, round(avg(embedding[1]), 6) AS f0, round(avg(embedding[2]), 6) AS f1, round(median(embedding[3]::DOUBLE), 6) AS f2, count(*) AS n FROM embeddings GROUP BY 1""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v,) = read(spark, sf_dir, "embeddings")
    f = [F.col("embedding")[i].cast("double") for i in range(3)]
    return v.groupBy("label").agg(F.round(F.avg(f[0]), 6).alias("f0"), F.round(F.avg(f[1]), 6).alias("f1"), F.round(F.median(f[2]), 6).alias("f2"), F.count("*").alias("n"))


@plan("""SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1""")
def explode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return p.select(F.explode(F.split("p_type", " ")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@plan("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    return reshape.json_children(e, ["event_id"], "props", "k long").filter("k IS NOT NULL")


@plan("""SELECT s_suppkey AS id, s_name AS name, s_acctbal::VARCHAR IS NOT NULL AS has_value, NULL::VARCHAR AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_mktsegment IS NOT NULL, c_mktsegment FROM customer""")
def union_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = read(spark, sf_dir, "supplier", "customer")
    a = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    b = c.select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value"), F.col("c_mktsegment").alias("segment"))
    return reshape.union_drift([a, b]).select("id", "name", F.col("value").isNotNull().alias("has_value"), "segment")


@plan("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer", "orders")
    return c.select(F.col("c_custkey").alias("id")).intersect(o.select("o_custkey"))


@plan("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = read(spark, sf_dir, "part", "lineitem")
    return p.select(F.col("p_partkey").alias("id")).subtract(l.filter("l_quantity > 48").select("l_partkey"))


@plan("""WITH m AS (SELECT DISTINCT l_returnflag AS s, l_orderkey AS x FROM lineitem), n AS (SELECT s, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT a.s AS a, b.s AS b, count(*) AS both_n FROM m a JOIN m b ON a.x = b.x AND a.s < b.s GROUP BY 1, 2)
SELECT a, b, both_n, round(both_n / (na.n + nb.n - both_n), 6) AS jaccard FROM p JOIN n na ON na.s = a JOIN n nb ON nb.s = b""")
def overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    m = l.select(F.col("l_returnflag").alias("s"), F.col("l_orderkey").alias("x")).distinct()
    return reshape.set_overlap(m, "s", "x").select("a", "b", "both_n", F.round("jaccard", 6).alias("jaccard"))


@plan("""SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 0 UNION ALL SELECT 'total', count(*) FROM orders""")
def two_level_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return o.rollup("o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderpriority", F.lit("total")).alias("o_orderpriority"), "n")


@plan("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return o.select("o_orderstatus", "o_orderpriority").distinct()
