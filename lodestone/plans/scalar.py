"""Scalar functions on the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.plans.common import plan, read

_NORM = "trim(regexp_replace(translate(lower({x}), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"


@plan(f"SELECT doc_id, {_NORM.format(x='text')} AS norm FROM documents")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = read(spark, sf_dir, "documents")
    return d.select("doc_id", S.norm_text(F.col("text")).alias("norm"))


_RAW = "CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name || ', Inc.' WHEN 1 THEN 'St. ' || p_name || '''s Hosp.' WHEN 2 THEN p_name || ' Med Ctr LLC d/b/a Other' ELSE p_name END"


@plan(f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part), a AS (SELECT p_partkey, {_NORM.format(x="regexp_replace(regexp_replace(lower(raw), '(d/b/a|dba) .*$', ''), '''', '', 'g')")} AS n FROM r),
b AS (SELECT p_partkey, array_to_string(list_transform(string_split(n, ' '), lambda w: CASE w WHEN 'hosp' THEN 'hospital' WHEN 'ctr' THEN 'center' WHEN 'med' THEN 'medical' WHEN 'st' THEN 'saint' ELSE w END), ' ') AS n FROM a)
SELECT p_partkey, regexp_replace(regexp_replace(n, '^the ', ''), '( (inc|llc|ltd|corp|co|pc|pllc|lp))+$', '') AS name FROM b""")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(S.name_tokens(F.expr(_RAW)), " ").alias("name"))


_ICD = "CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN 'bad code' ELSE chr(65 + (p_partkey % 26)::INT) || lpad(((p_partkey * 7) % 100)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '.' || (p_partkey % 100)::VARCHAR ELSE '' END END"
_BARE = "replace(upper(trim(code)), '.', '')"


@plan(f"""WITH c AS (SELECT p_partkey, {_ICD} AS code FROM part), b AS (SELECT p_partkey, CASE WHEN regexp_full_match({_BARE}, '[A-Z][0-9][0-9A-Z]{{1,5}}') THEN {_BARE} END AS nodot FROM c)
SELECT p_partkey, nodot, CASE WHEN length(nodot) > 3 THEN substr(nodot, 1, 3) || '.' || substr(nodot, 4) ELSE nodot END AS dotted, substr(nodot, 1, 3) AS category FROM b""")
def icd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    code = F.when(k % 10 == 0, "").when(k % 10 == 1, "bad code").otherwise(
        F.concat(F.chr(65 + k % 26), F.lpad((k * 7 % 100).cast("string"), 2, "0"), F.when(k % 3 == 0, F.concat(F.lit("."), (k % 100).cast("string"))).otherwise(""))
    )
    return p.select("p_partkey", S.icd_nodot(code).alias("nodot"), S.icd_dotted(code).alias("dotted"), S.icd_category(code).alias("category"))


@plan("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'abc' ELSE (1000000000 + c_custkey * 7919)::VARCHAR END AS npi FROM customer),
d AS (SELECT *, '80840' || npi AS s FROM n), t AS (SELECT c_custkey, npi, CASE WHEN regexp_full_match(npi, '[0-9]{10}') THEN
list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN (CASE WHEN substr(s, 16 - i, 1)::INT * 2 > 9 THEN substr(s, 16 - i, 1)::INT * 2 - 9 ELSE substr(s, 16 - i, 1)::INT * 2 END) ELSE substr(s, 16 - i, 1)::INT END)) END AS total FROM d)
SELECT c_custkey, npi, coalesce(total % 10 = 0, false) AS valid FROM t""")
def luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    npi = F.when(F.col("c_custkey") % 50 == 0, "abc").otherwise((1000000000 + F.col("c_custkey") * 7919).cast("string"))
    return c.select("c_custkey", npi.alias("npi"), S.luhn_npi(npi).alias("valid"))


_VD, _VP = (str(t) for t in (S.VERHOEFF_D, S.VERHOEFF_P))


@plan(f"""WITH n AS (SELECT c_custkey, (c_custkey * 104729)::VARCHAR AS number FROM customer),
d AS (SELECT c_custkey, number, list_transform(range(length(number)), lambda i: substr({_VP}[(i % 8) + 1], reverse(number)[i + 1]::INT + 1, 1)::INT) AS p FROM n)
SELECT c_custkey, number, list_reduce(list_prepend(0, p), lambda c, x: substr({_VD}[c + 1], x + 1, 1)::INT) = 0 AS valid FROM d""")
def verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    number = (F.col("c_custkey") * 104729).cast("string")
    return c.select("c_custkey", number.alias("number"), S.verhoeff_ok(number).alias("valid"))


@plan("SELECT s_suppkey, lpad(s_nationkey::VARCHAR, 2, '0') AS state, lpad((s_suppkey * 13 % 100000)::VARCHAR, 5, '0') AS county, CASE WHEN s_suppkey % 2 = 0 THEN lpad((s_suppkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS zip FROM supplier")
def fips_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    z = F.when(k % 2 == 0, F.concat(F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("-1234"))).otherwise(F.lit("12-3"))
    return s.select("s_suppkey", S.fips(F.col("s_nationkey"), 2).alias("state"), S.fips(k * 13 % 100000, 5).alias("county"), S.zip5(z).alias("zip"))


@plan("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, coalesce(try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%Y-%m-%d'), try_strptime(s || '-01', '%Y-%m-%d'))::DATE AS d FROM t""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, "n/a").otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.select("o_orderkey", S.parse_date(s, "MM/dd/yyyy", "yyyy-MM-dd", "yyyy-MM").alias("d"))


@plan("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 20 <> 0 THEN (c_custkey * 37 % 1000) / 10.0 END AS age FROM customer)
SELECT c_custkey, CASE WHEN age >= 90 THEN '90+' WHEN age >= 0 THEN (floor(age / 10) * 10)::INT || '-' || ((floor(age / 10) * 10)::INT + 9) END AS band,
CASE WHEN age >= 80 THEN '80+' WHEN age >= 0 THEN (floor(age / 10) * 10)::INT || '-' || ((floor(age / 10) * 10)::INT + 9) END AS top80 FROM a""")
def age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    age = F.when(F.col("c_custkey") % 20 != 0, (F.col("c_custkey") * 37 % 1000) / 10.0)
    return c.select("c_custkey", S.age_band(age).alias("band"), S.age_band(age, 80).alias("top80"))


@plan("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 THEN 0.0 ELSE l_quantity END AS e1, l_tax * 100 AS m1, CASE WHEN l_discount < 0.03 THEN 0.0 ELSE l_discount * 100 END AS e2, l_quantity / 5 AS m2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(CASE WHEN e1 = 0 THEN 0 ELSE m1 * m1 END + CASE WHEN e2 = 0 THEN 0 ELSE m2 * m2 END + pow(greatest(CASE WHEN e1 = 0 THEN m1 ELSE 0 END, CASE WHEN e2 = 0 THEN m2 ELSE 0 END), 2)), 6) AS moe FROM m""")
def moe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    e1, e2 = F.when(F.col("l_quantity") < 10, 0.0).otherwise(F.col("l_quantity")), F.when(F.col("l_discount") < 0.03, 0.0).otherwise(F.col("l_discount") * 100)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.moe_sum([e1, e2], [F.col("l_tax") * 100, F.col("l_quantity") / 5]), 6).alias("moe"))


@plan("SELECT user_id, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS best FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def json_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    values = F.from_json("props", "map<string,bigint>")
    per = e.filter(F.col("event_type").isin("click", "purchase")).select("user_id", F.array_max(F.map_values(F.map_filter(values, lambda k, v: k == "k"))).alias("m"))
    return per.groupBy("user_id").agg(F.max("m").alias("best"))


@plan(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]') THEN 'email' WHEN regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') THEN 'ssn'
WHEN regexp_matches(text, '\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b') THEN 'phone' WHEN regexp_matches(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b') THEN 'date' WHEN regexp_matches(text, '\b[0-9]{5}-[0-9]{4}\b') THEN 'zip' END AS kind FROM documents""")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = read(spark, sf_dir, "documents")
    return d.select("doc_id", S.refused_value(F.col("text")).alias("kind"))


@plan(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "pages")
    return p.select("page_id", S.strip_html(F.col("html")).alias("text"))


@plan(r"""WITH u AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (mg/dL)' WHEN 1 THEN ' (MG/DL )' ELSE '' END AS label FROM part)
SELECT p_partkey, CASE lower(trim(regexp_extract(label, '\(([^)]*)\)\s*$', 1))) WHEN 'mg/dl' THEN 'mg/dL' END AS unit FROM u""")
def unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    label = F.concat("p_name", F.when(k == 0, " (mg/dL)").when(k == 1, " (MG/DL )").otherwise(""))
    alias = F.create_map(F.lit("mg/dl"), F.lit("mg/dL"), F.lit("mmol/l"), F.lit("mmol/L"))
    return p.select("p_partkey", F.try_element_at(alias, F.lower(F.trim(F.regexp_extract(label, r"\(([^)]*)\)\s*$", 1)))).alias("unit"))


@plan("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "pages")
    return p.select("page_id", S.url_host(F.col("url")).alias("host"))


@plan("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_type || '  ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return p.select("p_partkey", S.slug(F.concat_ws("  ", "p_type", "p_brand")).alias("slug"))


@plan("SELECT c_nationkey, round(CASE WHEN sum(c_acctbal) > 0 THEN count(*) / sum(c_acctbal) * 1e5 END, 6) AS rate FROM customer GROUP BY 1")
def rate_per_100k(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    return c.groupBy("c_nationkey").agg(F.round(S.rate_per_100k(F.count("*"), F.sum("c_acctbal")), 6).alias("rate"))


@plan("""WITH a AS (SELECT s_nationkey, count(*) FILTER (s_acctbal > 5000)::DOUBLE AS k, count(*)::DOUBLE AS n FROM supplier GROUP BY 1)
SELECT s_nationkey, round((k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 / (1 + 3.841458820694124 / n) * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)), 6) AS lo,
round((k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 / (1 + 3.841458820694124 / n) * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)), 6) AS hi FROM a""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    a = s.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 5000).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return a.select("s_nationkey", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))
