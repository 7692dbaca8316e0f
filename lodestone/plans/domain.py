"""Statistics, entity resolution, text and governance on the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import ascii_words
from lodestone.operators import entity, governance, statistics, text
from lodestone.plans.common import plan, read
from lodestone.plans.lexicon import _LCS
from lodestone.plans.scalar import _NORM


@plan("""WITH c AS (SELECT n_regionkey AS h, c_nationkey AS j, sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN abs(c_acctbal) ELSE 0 END) AS w, sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN abs(c_acctbal) * (c_custkey % 2) ELSE 0 END) AS wy
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), t AS (SELECT sum(w) AS w, sum(wy) AS y FROM c),
z AS (SELECT h, (c.wy - t.y / t.w * c.w) / t.w AS z FROM c, t), s AS (SELECT h, count(*) AS n, var_samp(z) AS v FROM z GROUP BY 1)
SELECT round((SELECT y / w FROM t), 9) AS estimate, round(sqrt(sum(CASE WHEN n > 1 THEN n * v ELSE 0 END)), 9) AS se, (sum(n) - count(*))::BIGINT AS df FROM s""")
def taylor_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer", "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey).select("n_regionkey", "c_nationkey", F.abs("c_acctbal").alias("w"), (F.col("c_custkey") % 2).cast("double").alias("y"), "c_mktsegment")
    return statistics.taylor_mean(j, "y", "w", "n_regionkey", "c_nationkey", F.col("c_mktsegment") != "BUILDING").select(F.round("estimate", 9).alias("estimate"), F.round("se", 9).alias("se"), "df")


@plan("""WITH c AS (SELECT l_returnflag, l_linestatus, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2), s AS (SELECT l_linestatus, count(*) AS share FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(sum(m * share) / sum(share), 9) AS rate FROM c JOIN s USING (l_linestatus) GROUP BY 1""")
def standardized_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    standard = l.groupBy("l_linestatus").agg(F.count("*").alias("share"))
    return statistics.standardized_rate(l, ["l_returnflag"], "l_linestatus", "l_discount", "l_quantity", standard, "share").select("l_returnflag", F.round("rate", 9).alias("rate"))


_P = "SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN ((s_suppkey * 7919) % 997) / 9970.0 END AS p FROM supplier"


def _p(s: DataFrame) -> DataFrame:
    return s.select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 0, (F.col("s_suppkey") * 7919 % 997) / 9970.0).alias("p"))


@plan(f"""WITH p AS ({_P}), r AS (SELECT s_suppkey, p, row_number() OVER (ORDER BY p, s_suppkey) AS i, count(*) OVER () AS n FROM p WHERE p IS NOT NULL),
a AS (SELECT s_suppkey, least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT s_suppkey, round(q, 9) AS q FROM p LEFT JOIN a USING (s_suppkey)""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    return statistics.bh_adjust(_p(s), "p", "s_suppkey", "q").select("s_suppkey", F.round("q", 9).alias("q"))


@plan(f"""WITH p AS ({_P}), r AS (SELECT s_suppkey, p, row_number() OVER (ORDER BY p, s_suppkey) AS i, count(*) OVER () AS n FROM p WHERE p IS NOT NULL),
a AS (SELECT s_suppkey, least(1.0, max(p * (n - i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT s_suppkey, round(q, 9) AS q FROM p LEFT JOIN a USING (s_suppkey)""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    return statistics.holm_adjust(_p(s), "p", "s_suppkey", "q").select("s_suppkey", F.round("q", 9).alias("q"))


_XY = "SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)"


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents", "labels")
    return d.select("doc_id", "n_chars").join(l, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("x"), F.col("quality").alias("y"))


@plan(f"""WITH r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM ({_XY}))
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auroc, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM r""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.auroc(_xy(spark, sf_dir), "x", "y").select(F.round("auroc", 9).alias("auroc"), "n1", "n0")


@plan(f"""WITH d AS ({_XY}), c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM d WHERE y = 0), t AS (SELECT min(x) AS threshold FROM c WHERE i >= ceil(n * 0.9))
SELECT threshold::DOUBLE AS threshold, round(avg((x > threshold)::INT), 9) AS sensitivity FROM d, t WHERE y = 1 GROUP BY 1""")
def sens_at_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sens_at_spec(_xy(spark, sf_dir), "x", "y", 0.9).select("threshold", F.round("sensitivity", 9).alias("sensitivity"))


@plan("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = read(spark, sf_dir, "lineitem")
    return statistics.spearman(l, "l_quantity", "l_extendedprice").select(F.round("rho", 9).alias("rho"), "n")


@plan(f"""WITH a AS (SELECT avg(x) FILTER (y = 1) AS m1, avg(x) FILTER (y = 0) AS m0, var_samp(x) FILTER (y = 1) AS v1, var_samp(x) FILTER (y = 0) AS v0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM ({_XY}))
SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) * (1 - 3 / (4.0 * (n1 + n0) - 9)), 9) AS g, n1, n0 FROM a""")
def hedges_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.hedges_g(_xy(spark, sf_dir), "x", "y").select(F.round("g", 9).alias("g"), "n1", "n0")


@plan("""WITH s AS (SELECT avg(c_acctbal) AS m, quantile_cont(c_acctbal, 0.99) - quantile_cont(c_acctbal, 0.01) AS r, avg(c_nationkey) AS m2, quantile_cont(c_nationkey, 0.99) - quantile_cont(c_nationkey, 0.01) AS r2 FROM customer)
SELECT c_custkey, round((least(1.0, abs(c_acctbal - m) / r) + least(1.0, abs(c_nationkey - m2) / r2)) / 2, 9) AS gower FROM customer, s""")
def gower(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    return statistics.gower_to_centroid(c, ["c_acctbal", "c_nationkey"]).select("c_custkey", F.round("gower", 9).alias("gower"))


@plan("""WITH lib AS (SELECT p_partkey AS item, p_brand AS term FROM part), picked AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_quantity > 49.5), n AS (SELECT count(*) AS drawn FROM picked), t AS (SELECT count(*) AS background FROM lib),
c AS (SELECT term, count(picked.item) AS hits, count(*) AS size FROM lib LEFT JOIN picked USING (item) GROUP BY 1) SELECT term, hits, size, drawn, background, round(hits * background / (size * drawn)::DOUBLE, 9) AS fold FROM c, n, t""")
def ora_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = read(spark, sf_dir, "part", "lineitem")
    lib = p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("term"))
    out = statistics.over_representation(l.filter("l_quantity > 49.5").select(F.col("l_partkey").alias("item")), lib, "item", "term")
    return out.select("term", "hits", "size", "drawn", "background", F.round("fold", 9).alias("fold"))


@plan("""WITH b AS (SELECT c_nationkey, c_mktsegment, floor(c_acctbal / 100) AS band, c_custkey FROM customer) SELECT x.c_custkey AS a, y.c_custkey AS b FROM b x JOIN b y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.band = y.band AND x.c_custkey < y.c_custkey""")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = read(spark, sf_dir, "customer")
    return entity.block_pairs(c.withColumn("band", F.floor(F.col("c_acctbal") / 100)), "c_custkey", ["c_nationkey", "c_mktsegment", "band"])


@plan("""SELECT a, b FROM (SELECT s_suppkey AS b, min(s_suppkey) OVER (PARTITION BY s_nationkey, floor(s_acctbal / 1000)) AS a FROM supplier) WHERE a <> b""")
def exact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    return entity.anchor_edges(s.withColumn("k", F.floor(F.col("s_acctbal") / 1000)), "s_suppkey", ["s_nationkey", "k"])


@plan("SELECT p_brand, p_size, min(p_partkey) AS anchor, count(*) AS n FROM part GROUP BY 1, 2")
def group_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    return p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("anchor"), F.count("*").alias("n"))


@plan("""WITH RECURSIVE e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT c_custkey AS a, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey // 2 END AS b FROM customer) WHERE a <> b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over all customers: each hangs on the one of half its key, but for the roots."""
    (c,) = read(spark, sf_dir, "customer")
    edges = c.select(F.col("c_custkey").cast("long").alias("a"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey div 2 END").cast("long").alias("b"))
    return entity.components(edges)


@plan(f"""WITH n AS (SELECT p_partkey, p_brand, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS s FROM part),
x AS (SELECT u.p_partkey AS p, v.p_partkey AS q, string_split(u.s, '') AS a, string_split(v.s, '') AS b FROM n u JOIN n v ON u.p_brand = v.p_brand AND u.p_partkey < v.p_partkey AND abs(length(u.s) - length(v.s)) * 100 <= 15 * (length(u.s) + length(v.s))),
d AS (SELECT DISTINCT a, b FROM x), r AS (SELECT a, b, 200.0 * {_LCS} / (len(a) + len(b)) AS ratio FROM d) SELECT p AS a, q AS b, round(ratio, 6) AS ratio FROM x JOIN r USING (a, b) WHERE ratio >= 85""")
def fuzzy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand whose names agree by token-sort ratio."""
    (p,) = read(spark, sf_dir, "part")
    return entity.fuzzy_edges(p, "p_partkey", "p_name", ["p_brand"], 85).withColumn("ratio", F.round("ratio", 6))


_CONF = "SELECT a.s_suppkey AS a, b.s_suppkey AS b, 1 / (b.s_suppkey - a.s_suppkey)::DOUBLE AS conf FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND b.s_suppkey - a.s_suppkey < 40"


@plan(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY conf DESC, a, b) AS i FROM ({_CONF})), n AS (SELECT list(s_suppkey ORDER BY s_suppkey) AS ids, list((s_suppkey % 10 = 0)::INT ORDER BY s_suppkey) AS singles FROM supplier),
r AS (SELECT 0::BIGINT AS i, ids AS lab, ids, singles FROM n UNION ALL
  SELECT e.i, CASE WHEN list_sum(list_transform(lab, lambda l, k: CASE WHEN l IN (lab[list_position(ids, a)], lab[list_position(ids, b)]) THEN singles[k] ELSE 0 END)) <= 1
    THEN list_transform(lab, lambda l: CASE WHEN l = greatest(lab[list_position(ids, a)], lab[list_position(ids, b)]) THEN least(lab[list_position(ids, a)], lab[list_position(ids, b)]) ELSE l END) ELSE lab END, ids, singles FROM r JOIN e ON e.i = r.i + 1)
SELECT unnest(ids) AS id, unnest(lab) AS cluster FROM (SELECT ids, lab FROM r ORDER BY i DESC LIMIT 1)""")
def constrained_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers joined in order of confidence, at most one of a kind in a cluster."""
    (s,) = read(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 10 == 0, "unique").otherwise("plain").alias("kind"))
    a, b = s.alias("a"), s.alias("b")
    edges = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")) & (F.col("b.s_suppkey") - F.col("a.s_suppkey") < 40))
    edges = edges.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), (1 / (F.col("b.s_suppkey") - F.col("a.s_suppkey"))).alias("conf"))
    return entity.constrained_clusters(nodes, edges, "unique")


@plan(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '(?i)license version [0-9]', ' ', 'g') AS t FROM documents) SELECT doc_id, lower(regexp_extract(t, '(?i)\b(licensed under|released under)\b')) AS mention FROM t WHERE regexp_matches(t, '(?i)\b(licensed under|released under)\b')""")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = read(spark, sf_dir, "documents")
    return text.mentions(d, "doc_id", "text", ascii_words("(?i)(licensed under|released under)"), r"(?i)license version [0-9]")


@plan(f"""WITH lex AS (SELECT {_NORM.format(x="p_type")} AS k, min(p_partkey) AS id, count(DISTINCT p_brand) AS n FROM part WHERE p_size < 10 GROUP BY 1), q AS (SELECT p_partkey, {_NORM.format(x="upper(p_type) || ' !'")} AS k FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'exact' END AS how FROM q LEFT JOIN lex USING (k)""")
def lexicon_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = read(spark, sf_dir, "part")
    lexicon = p.filter("p_size < 10").select(F.col("p_type").alias("term"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("sense"))
    return text.resolve(p.select("p_partkey", F.concat(F.upper("p_type"), F.lit(" !")).alias("q")), "q", lexicon).select("p_partkey", "id", "how")


@plan(f"""WITH q AS (SELECT item_id, {_NORM.format(x="text")} AS q FROM benchmark), d AS (SELECT doc_id, {_NORM.format(x="text")} AS t FROM documents) SELECT item_id, count(doc_id) AS n_sources FROM q LEFT JOIN d ON contains(t, q) GROUP BY 1""")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = read(spark, sf_dir, "benchmark", "documents")
    return text.quote_sources(b, "item_id", "text", d, "doc_id", "text")


_PROV = "SELECT doc_id, source AS source_name, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id::VARCHAR END AS source_record_id, CASE WHEN doc_id % 70 = 0 THEN '' ELSE lang END AS evidence_type FROM documents"


@plan(f"SELECT 'evidence_type' AS column_name, count(*) FILTER (evidence_type IS NULL OR trim(evidence_type) = '') AS problems FROM ({_PROV}) UNION ALL SELECT 'source_name', count(*) FILTER (source_name IS NULL OR trim(source_name) = '') FROM ({_PROV}) UNION ALL SELECT 'source_record_id', count(*) FILTER (source_record_id IS NULL) FROM ({_PROV})")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = read(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("source_name"), F.when(F.col("doc_id") % 50 != 0, F.col("doc_id").cast("string")).alias("source_record_id"), F.when(F.col("doc_id") % 70 == 0, "").otherwise(F.col("lang")).alias("evidence_type"))
    return governance.blank_counts(rows, ["evidence_type", "source_name", "source_record_id"])


@plan("""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 'doc' WHEN doc_id % 41 = 0 THEN ':x' ELSE source || ':' || doc_id END AS oid FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(oid, '[a-z][a-z0-9_]*:.+') THEN split_part(oid, ':', 1) END AS namespace, CASE WHEN regexp_full_match(oid, '[a-z][a-z0-9_]*:.+') THEN substr(oid, instr(oid, ':') + 1) END AS native FROM i""")
def object_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    (d,) = read(spark, sf_dir, "documents")
    oid = F.when(F.col("doc_id") % 40 == 0, "doc").when(F.col("doc_id") % 41 == 0, ":x").otherwise(F.concat_ws(":", "source", F.col("doc_id").cast("string")))
    return d.select("doc_id", *governance.object_id(oid))


@plan("""WITH r AS (SELECT event_id, event_type, value, user_id FROM events) SELECT 'event_type in vocabulary' AS rule, count(*) FILTER (event_type NOT IN ('click', 'purchase', 'view')) AS broken FROM r UNION ALL
SELECT 'value in range', count(*) FILTER (NOT (value BETWEEN 0 AND 100)) FROM r UNION ALL SELECT 'event_id unique', count(*) - count(DISTINCT event_id) FROM r""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    rules = {"event_type in vocabulary": F.col("event_type").isin("click", "purchase", "view"), "value in range": F.col("value").between(0, 100)}
    return governance.contract(e, rules, unique=["event_id"])


@plan("SELECT 'supplier' AS table_name, count(*) AS old_rows, count(*) FILTER (s_suppkey % 11 <> 0) AS new_rows, count(*) FILTER (s_suppkey % 11 <> 0) - count(*) AS delta FROM supplier")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (s,) = read(spark, sf_dir, "supplier")
    return governance.count_diff({"supplier": (s, s.filter("s_suppkey % 11 <> 0"))})


@plan("""WITH want AS (SELECT unnest([7, 70, 700]) AS k) SELECT k AS o_orderkey, o.o_custkey, c.c_name, count(l.l_orderkey) AS n_lines FROM want LEFT JOIN orders o ON o_orderkey = k LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN lineitem l ON l_orderkey = k GROUP BY ALL""")
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an order's id to its customer and lines; the ids are a question's, not a sample."""
    o, c, l = read(spark, sf_dir, "orders", "customer", "lineitem")
    want = [7, 70, 700]
    ids = spark.createDataFrame([(k,) for k in want], "o_orderkey long")
    lines = l.filter(F.col("l_orderkey").isin(want)).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = ids.join(o.filter(F.col("o_orderkey").isin(want)), "o_orderkey", "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select(F.col("o_orderkey").cast("int").alias("o_orderkey"), "o_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_lines"))
