"""Records, lists, text keys and checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import governance, ranking, records
from lodestone.plans.common import plan, read
from lodestone.plans.scalar import _NORM


@plan("""SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN rank() OVER (PARTITION BY c_mktsegment, c_nationkey < 20 ORDER BY floor(c_acctbal / 100) DESC) END AS rk FROM customer""")
def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    x = c.withColumn("v", F.floor(F.col("c_acctbal") / 100))
    return records.competition_rank(x, "v", F.col("c_nationkey") < 20, ["c_mktsegment"], "rk").select("c_custkey", F.col("rk").cast("long").alias("rk"))


@plan("SELECT o_custkey, count(*) AS total, least(count(*), 5) AS returned, count(*) > 5 AS truncated FROM orders GROUP BY 1")
def truncation_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return records.limit_with_record(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)[1].withColumn("returned", F.col("returned").cast("long"))


@plan("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def truncated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return records.limit_with_record(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)[0].select("o_custkey", "o_orderkey")


@plan("""SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "A", round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "N", round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "R" FROM lineitem GROUP BY 1""")
def unstack_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    out = records.unstack(l, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_quantity")
    return out.select("l_suppkey", *[F.round(c, 2).alias(c) for c in "ANR"])


@plan("""SELECT l_orderkey, l_linenumber, l_partkey, m AS measure, CASE m WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS amount FROM lineitem, (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) AS v(m)""")
def stack_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return records.stack(l, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@plan("""WITH w AS (SELECT DISTINCT c_custkey AS k FROM customer), f AS (SELECT DISTINCT o_custkey + 100 AS k FROM orders)
SELECT (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM w JOIN f USING (k)) AS matched, (SELECT count(*) FROM w ANTI JOIN f USING (k)) AS missing, (SELECT count(*) FROM f ANTI JOIN w USING (k)) AS extra,
round((SELECT count(*) FROM w JOIN f USING (k)) / (SELECT count(*) FROM w), 9) AS share""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer", "orders")
    return records.coverage(c.select(F.col("c_custkey").alias("k")), o.select((F.col("o_custkey") + 100).alias("k")), "k").withColumn("share", F.round("share", 9))


@plan("SELECT * FROM (VALUES ('customer', true, true), ('orders', true, true), ('missing', false, false), ('empty', true, false)) AS v(name, there, filled)")
def required_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer", "orders")
    return records.required_tables({"customer": c, "orders": o, "missing": None, "empty": o.filter("o_orderkey < 0")})


@plan("SELECT * FROM (VALUES ('tier', 'added'), ('s_acctbal', 'removed')) AS v(\"column\", change)")
def column_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    return records.column_difference(s, s.drop("s_acctbal").withColumn("tier", F.lit(1)))


@plan("""WITH n AS (SELECT l_suppkey, l_returnflag || '|' || l_linestatus || ':' || count(*) AS p FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus) SELECT l_suppkey, string_agg(p, ';' ORDER BY p) AS pairs FROM n GROUP BY 1""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return records.pair_counts_text(l, ["l_suppkey"], "l_returnflag", "l_linestatus")


@plan("""WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS b FROM part)
SELECT p_partkey, CASE WHEN a IS NOT NULL THEN 'price' WHEN b IS NOT NULL THEN 'size' END AS basis,
row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END, coalesce(a, b) DESC NULLS LAST, p_partkey) AS "rank" FROM x""")
def rank_by_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    bases = [("price", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice"))), ("size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")))]
    return records.rank_by_basis(p, ["p_brand"], bases, "p_partkey").select("p_partkey", "basis", F.col("rank").cast("long").alias("rank"))


@plan("""WITH x AS (SELECT c_custkey, floor(c_acctbal / 250) AS v FROM customer), r AS (SELECT *, rank() OVER (ORDER BY v DESC) - 1 AS above, count(*) OVER (PARTITION BY v) AS tied FROM x),
p AS (SELECT c_custkey, least(1.0, greatest(0.0, (100 - above) / tied)) AS p FROM r)
SELECT round(sum(p) FILTER (c_custkey % 4 = 0), 6) AS overlap, count(*) FILTER (p > 0 AND p < 1) AS tied FROM p""")
def tie_averaged_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    x = ranking.topn_inclusion(c.select("c_custkey", F.floor(F.col("c_acctbal") / 250).alias("v")), "v", 100, "p")
    return records.tie_averaged_overlap(x, "p", c.filter("c_custkey % 4 = 0"), "c_custkey").withColumn("overlap", F.round("overlap", 6))


_SOURCE = "CASE l_partkey % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'survey' ELSE 'claims' END"


@plan(f"""WITH x AS (SELECT l_suppkey, {_SOURCE} AS source, l_orderkey FROM lineitem), m AS (SELECT l_suppkey, min_by({{'s': source, 'o': l_orderkey}}, CASE source WHEN 'survey' THEN 0 WHEN 'registry' THEN 1 ELSE 2 END * 1000000000 + l_orderkey) AS b FROM x GROUP BY 1)
SELECT l_suppkey, b.s || ':' || b.o AS canonical FROM m""")
def canonical_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return records.by_priority(l.withColumn("source", F.expr(_SOURCE)), "l_suppkey", "source", ["survey", "registry"], "l_orderkey")


@plan(f"""WITH x AS (SELECT l_orderkey, {_SOURCE} AS source, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT source, count(*) AS "groups", sum(n)::BIGINT AS records FROM x WHERE n > 1 AND source IN ('registry', 'claims') GROUP BY 1""")
def link_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return records.link_rejects(l.withColumn("source", F.expr(_SOURCE)), "l_orderkey", "source", ["registry", "claims"])


@plan("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 25) USING (l_partkey)")
def broad_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return records.broad_ids(l, "l_partkey", "l_suppkey", 25).select("l_orderkey", "l_linenumber", "l_partkey")


@plan("""WITH m AS (SELECT DISTINCT p_brand, p_size % 5 AS g FROM part WHERE p_size < 4 AND p_brand <> 'Brand#11') SELECT b.p_brand, count(DISTINCT g) AS "groups" FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN m USING (p_brand) GROUP BY 1 HAVING count(DISTINCT g) <> 1""")
def taxonomy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return records.taxonomy_check(p, "p_brand", p.filter("p_size < 4 AND p_brand <> 'Brand#11'").withColumn("g", F.col("p_size") % 5), "g")


@plan("""WITH x AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS off, max(ts) FILTER (event_type = 'click') AS "on" FROM events GROUP BY 1) SELECT user_id, off, "on" FROM x WHERE off IS NOT NULL AND ("on" IS NULL OR "on" < off)""")
def still_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    x = e.select("user_id", F.when(F.col("event_type") == "purchase", F.col("ts")).alias("o"), F.when(F.col("event_type") == "click", F.col("ts")).alias("i"))
    return records.still_inactive(x, "user_id", "o", "i")


@plan("""WITH x AS (SELECT lang, n_chars // 500 AS s, quality AS y FROM documents JOIN labels USING (doc_id)), a AS (SELECT lang, s, count(*) FILTER (y = 1) AS h, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT *, sum(h) OVER w AS hits, sum(n) OVER w AS al FROM a WINDOW w AS (PARTITION BY lang ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT lang, round(sum(h * hits / al) / nullif(sum(h), 0), 9) AS ap FROM r GROUP BY 1""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents", "labels")
    x = d.join(l, "doc_id").select("lang", F.expr("n_chars div 500").alias("s"), F.col("quality").alias("y"))
    return records.average_precision(x, "s", "y", ["lang"]).withColumn("ap", F.round("ap", 9))


@plan("SELECT o_custkey, min(year(o_orderdate)) AS first FROM orders GROUP BY 1")
def first_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return records.first_seen(o.withColumn("y", F.year("o_orderdate").cast("long")), "o_custkey", "y")


@plan("""WITH d AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM d)
SELECT round(max(b), 6) AS slope, round(sqrt(sum(pow((x - mx) * (y - my - b * (x - mx)) / (1 - 1.0 / n - pow(x - mx, 2) / sxx), 2))) / max(sxx), 6) AS se, max(n) AS n FROM d, s""")
def ols_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return records.ols_hc3(p, "p_size", "p_retailprice").select(F.round("slope", 6).alias("slope"), F.round("se", 6).alias("se"), "n")


_CITY = "CASE c_custkey % 6 WHEN 0 THEN 'St. Paul,  MN' WHEN 1 THEN 'new  york' WHEN 2 THEN '12 Main St, Suite 4' WHEN 3 THEN 'São Paulo' WHEN 4 THEN 'L''Anse-Mt Ste' ELSE '12 main st. #7' END"


@plan(f"""WITH x AS (SELECT c_custkey, {_CITY} AS t, CASE c_custkey % 6 WHEN 0 THEN 'saint paul mn' WHEN 1 THEN 'new york' WHEN 2 THEN '12 main saint suite 4' WHEN 3 THEN 'sao paulo' WHEN 4 THEN 'lanse mount sainte' ELSE '12 main saint 7' END AS city FROM customer) SELECT c_custkey, city,
trim(regexp_replace(regexp_replace(upper(t), '(,| )+(STE|SUITE|UNIT|APT|#).*$', ''), '[^A-Z0-9]+', ' ', 'g')) AS address,
{_NORM.format(x="t")} || '|' || trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) || '|' AS k FROM x JOIN customer USING (c_custkey)""")
def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    t = F.expr(_CITY.replace("L''Anse", "L\\'Anse"))
    return c.select("c_custkey", S.city_key(t).alias("city"), S.address_key(t).alias("address"), S.composite_key(t, F.col("c_mktsegment"), F.lit(None).cast("string")).alias("k"))


_CURIE = "CASE p_partkey % 5 WHEN 0 THEN 'mondo_00' || p_partkey WHEN 1 THEN 'HP:' || p_partkey WHEN 2 THEN ' orphanet:' || p_partkey WHEN 3 THEN 'xyz_' || p_partkey ELSE 'no id ' || p_partkey END"


@plan(f"""WITH x AS (SELECT p_partkey, trim({_CURIE}) AS t FROM part), y AS (SELECT p_partkey, regexp_extract(t, '^([A-Za-z]+)[:_]([A-Za-z0-9.]+)$', 1) AS a, regexp_extract(t, '^([A-Za-z]+)[:_]([A-Za-z0-9.]+)$', 2) AS b FROM x)
SELECT p_partkey, CASE WHEN a <> '' THEN CASE lower(a) WHEN 'orphanet' THEN 'Orphanet' ELSE upper(a) END || ':' || b END AS curie FROM y""")
def curie(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return p.select("p_partkey", S.curie(F.expr(_CURIE)).alias("curie"))


_LOG = "'seen ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' and 2020-01-02 03:04:05, not 2020-01-02'"


@plan(f"""SELECT o_orderkey, CASE WHEN regexp_matches(d, '^[0-9]{{4}}') THEN substr(d, 1, 4)::INT END AS y, len(regexp_extract_all({_LOG}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')) AS n, o_orderdate AS first,
CASE WHEN year(o_orderdate) >= 1997 THEN 'new' WHEN year(o_orderdate) >= 1994 THEN 'middle' END AS period FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'about 1999' ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders)""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    found = S.timestamp_list(F.concat(F.lit("seen "), stamp, F.lit(" and 2020-01-02 03:04:05, not 2020-01-02")))
    d = F.when(F.col("o_orderkey") % 3 == 0, "about 1999").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return o.select("o_orderkey", S.date_year(d).cast("long").alias("y"), F.size(found).cast("long").alias("n"), found[0].cast("timestamp_ntz").alias("first"), S.period_of_year(F.year("o_orderdate"), {1994: "middle", 1997: "new"}).alias("period"))


#: Texts and the uses of forbidden phrases in them, told by hand.
_NOTES = [
    ('It will CURE you, a "cure" they said', "1:CURE"), ('he said "this cures all, a cure"\nand it treats', "1:cure,2:treats"), ("Avoid (unless proven): cure; treats, diagnosis of and cure", ""),
    ("never say it treats, it is a cure", "1:treats,1:cure"), ("this cure works, never\rsay `treats`", "1:cure"), ("no diagnosis  of, no cured, no 'diagnosis of'", ""),
]
#: Names of sites, their cities, and whether they tell of no facility.
_SITES = [
    ("Research Site", "x", True), ("Pfizer Investigational Site", "x", True), ("Duke Clinical Research Site", "x", False), ("Investigational Site Number : 8400001", "x", True), ("Denver, Colorado", "Denver", True),
    ("Denver Health", "Denver", False), ("Contact Medtronic for Exact Locations", "x", True), ("Contact Lens Institute", "x", False), ("Participants\' homes", "x", True), ("Remote Monitoring Clinic", "x", False),
]


def _picked(key: str, values: list, duck: bool) -> str:
    """A value by the key's remainder, as SQL."""
    text = lambda v: str(v).upper() if isinstance(v, bool) else ("'" + v.replace("\\'", "'").replace("'", "''") + "'" if duck else "'" + v.replace("\\'", "'").replace("\\", "\\\\").replace("'", "\\'") + "'")
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


@plan(f"SELECT p_partkey, {_picked('p_partkey', [n[1] for n in _NOTES], True)} AS hits, {_picked('p_partkey', [x[2] for x in _SITES], True)} AS generic FROM part")
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of forbidden phrases and names of no facility; the SQL holds what a reader finds in the texts."""
    (p,) = read(spark, sf_dir, "part")
    note, name, city = (F.expr(_picked("p_partkey", [r[i] for r in rows], False)) for rows, i in ((_NOTES, 0), (_SITES, 0), (_SITES, 1)))
    hits = S.forbidden_hits(note, ["cure", "treats", "diagnosis of"])
    shown = F.transform(hits, lambda h: F.concat_ws(":", h["line"].cast("string"), h["term"]))
    return p.select("p_partkey", F.array_join(shown, ",").alias("hits"), S.generic_name(name, city, F.lit("Colorado")).alias("generic"))


_REFUSED = "regexp_matches({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{5}}-[0-9]{{4}}')"


@plan(f"""WITH v AS (SELECT 'text' AS c, text AS x FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'home_phone', CASE WHEN doc_id % 3 = 0 THEN '555-' || (100 + doc_id % 900) || '-1234' END FROM documents UNION ALL SELECT 'birthdate', NULL FROM documents)
SELECT c AS "column", CASE c WHEN 'home_phone' THEN 'identity' WHEN 'birthdate' THEN 'date' END AS by_name, count(*) FILTER ({_REFUSED.format(x="x")}) AS refused, count(x) AS filled FROM v GROUP BY 1""")
def sensitive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns by what their names tell and by how many of their values look personal."""
    (d,) = read(spark, sf_dir, "documents")
    phone = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("555-"), (100 + F.col("doc_id") % 900).cast("string"), F.lit("-1234")))
    return governance.sensitive_columns(d.withColumn("home_phone", phone).withColumn("birthdate", F.lit(None).cast("string")))


@plan("""WITH x AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'us ' WHEN 1 THEN 'FR' WHEN 2 THEN 'USA' END AS country, CASE s_suppkey % 3 WHEN 0 THEN 'mn' WHEN 1 THEN 'PR' ELSE 'XX' END AS state FROM supplier)
SELECT s_suppkey, CASE WHEN coalesce(upper(trim(country)) IN ('US', 'USA', 'UNITED STATES'), false) AND upper(state) IN ('MN', 'NY') THEN 'us-state'
WHEN (coalesce(upper(trim(country)) IN ('US', 'USA', 'UNITED STATES'), false) OR country IS NULL) AND upper(state) IN ('PR', 'GU') THEN 'us-territory' WHEN NOT upper(trim(country)) IN ('US', 'USA', 'UNITED STATES') THEN 'foreign' ELSE 'unknown' END AS place FROM x""")
def us_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    country = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'us ' WHEN 1 THEN 'FR' WHEN 2 THEN 'USA' END")
    state = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'mn' WHEN 1 THEN 'PR' ELSE 'XX' END")
    return s.select("s_suppkey", S.us_location(country, state, ["MN", "NY"], ["PR", "GU"]).alias("place"))


@plan("""WITH a AS (SELECT lang, (sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc, n1, n0 FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r, count(*) FILTER (y = 1) OVER (PARTITION BY lang) AS n1, count(*) FILTER (y = 0) OVER (PARTITION BY lang) AS n0
FROM (SELECT lang, n_chars // 100 AS s, quality AS y FROM documents JOIN labels USING (doc_id))) GROUP BY lang, n1, n0)
SELECT lang, round(auc, 9) AS auroc, round(sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n0)), 9) AS se FROM a""")
def hanley_mcneil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.statistics import auroc

    d, l = read(spark, sf_dir, "documents", "labels")
    x = d.join(l, "doc_id").select("lang", F.expr("n_chars div 100").alias("s"), F.col("quality").alias("y"))
    a = auroc(x, "s", "y", ["lang"])
    return a.select("lang", F.round("auroc", 9).alias("auroc"), F.round(S.hanley_mcneil_se(F.col("auroc"), F.col("n1"), F.col("n0")), 9).alias("se"))
