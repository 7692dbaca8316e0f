"""Lexicon look-ups: phrases of the benchmark in all documents, part names by misspelt and partial queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import lexicon
from lodestone.plans.common import plan, read
from lodestone.plans.scalar import _NORM

#: Phrases of an item as (first word from 1, how many); they overlap one another.
_PHRASES = [(1, 2), (2, 3), (4, 5), (6, 1)]


@plan(f"""WITH b AS (SELECT item_id, string_split({_NORM.format(x="text")}, ' ') AS w FROM benchmark), t AS (SELECT DISTINCT item_id * 10 + a AS term_id, array_to_string(w[a : a + n - 1], ' ') AS g, n FROM b, (VALUES {', '.join(map(str, _PHRASES))}) AS v(a, n) WHERE len(w) >= a + n - 1),
d AS (SELECT doc_id, string_split({_NORM.format(x="coalesce(text, '')")}, ' ') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
g AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM p, (SELECT DISTINCT n FROM t) WHERE s + n - 1 <= len(w)), m AS (SELECT doc_id, s - 1 AS s, s - 1 + n AS e, term_id, length(g) AS c FROM g JOIN t USING (g, n)),
l AS (SELECT doc_id, list_transform(list_sort(list({{'n': -c, 's': s, 'i': term_id, 'e': e}})), lambda x: [x]) AS l FROM m GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(a, x) ELSE a END)) AS k FROM l)
SELECT doc_id, k.s::INT AS start, k.e::INT AS "end", k.i AS term_id FROM k""")
def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest phrases of benchmark items that stand in each document and don't overlap."""
    d, b = read(spark, sf_dir, "documents", "benchmark")
    w = lexicon.words(F.col("text"))
    phrase = lambda a, n: F.when(F.size(w) >= a + n - 1, F.struct((F.col("item_id") * 10 + a).alias("term_id"), F.array_join(F.slice(w, a, n), " ").alias("term")))
    terms = b.select(F.explode(F.array(*[phrase(a, n) for a, n in _PHRASES])).alias("t")).filter("t IS NOT NULL").select("t.*")
    return lexicon.spans(d, "doc_id", "text", terms, "term", "term_id")


_Q = """SELECT min(p_partkey) AS q, t FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || 's!' WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN substr(p_name, 1, 1) || substr(p_name, 3)
 WHEN 3 THEN 'the ' || p_name || ' kind' WHEN 4 THEN split_part(p_name, ' ', 2) ELSE p_name || p_name[-1] || ' ' END AS t FROM part) GROUP BY t"""
_SINGULAR = "array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) > 3 AND w[-1] = 's' AND w[-2:] <> 'ss' THEN w[:-2] ELSE w END), ' ')"
_ZEROS = "list_transform(range(len(b) + 1), lambda i: 0::BIGINT)"
_LCS = f"""list_reduce([{_ZEROS}] || list_transform(a, lambda x: [ascii(x)::BIGINT]), lambda prev, x: list_reduce([[0::BIGINT]] || list_transform(range(1, len(b) + 1), lambda j: [j]),
  lambda cur, j: list_append(cur, CASE WHEN ascii(b[j[1]]) = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[len(cur)]) END)))[len(b) + 1]"""


@plan(f"""WITH q AS (SELECT q, {_NORM.format(x="t")} AS n FROM ({_Q})), e AS (SELECT min(p_partkey) AS id, p_name AS term, 1 - (min(p_partkey) % 3) * 0.1::DOUBLE AS w, {_NORM.format(x="p_name")} AS n FROM part GROUP BY p_name),
x AS (SELECT q, id, term, w, q.n AS qn, e.n AS en, list_distinct(string_split({_SINGULAR.format(x="q.n")}, ' ')) AS qt, list_distinct(string_split({_SINGULAR.format(x="e.n")}, ' ')) AS et,
  {_SINGULAR.format(x="q.n")} = {_SINGULAR.format(x="e.n")} OR replace(q.n, ' ', '') = replace(e.n, ' ', '') AS same,
  string_split(array_to_string(list_sort(string_split(q.n, ' ')), ' '), '') AS a, string_split(array_to_string(list_sort(string_split(e.n, ' ')), ' '), '') AS b FROM q, e),
r AS (SELECT *, CASE WHEN same THEN 0 WHEN abs(len(a) - len(b)) * 100 <= 12 * (len(a) + len(b)) THEN 100 - 100 * (len(a) + len(b) - 2 * {_LCS}) / (len(a) + len(b))::DOUBLE ELSE 0 END AS ratio FROM x),
s AS (SELECT q, id, term, w * CASE WHEN same THEN 1 WHEN (list_has_all(et, qt) AND 2 * len(qt) >= len(et)) OR (list_has_all(qt, et) AND 2 * len(et) >= len(qt) AND len(list_filter(et, lambda w: length(w) >= 4)) > 0) THEN 0.8 WHEN ratio >= 88 - 1e-9 THEN 0.75 * ratio / 100 ELSE 0 END AS score,
  CASE WHEN same THEN 'exact' WHEN (list_has_all(et, qt) AND 2 * len(qt) >= len(et)) OR (list_has_all(qt, et) AND 2 * len(et) >= len(qt)) THEN 'subset' ELSE 'spelling' END AS how FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(-score, 9), id) AS place FROM s WHERE score >= 0.6 - 1e-12) SELECT q AS query, id, round(score, 4) AS score, how, term, place::INT AS place FROM p WHERE place <= 5""")
def entry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best part names for plurals, turned, partial, wrapped and misspelt names."""
    (p,) = read(spark, sf_dir, "part")
    p.createOrReplaceTempView("_search_part")
    queries = spark.sql(_Q.replace("FROM part)", "FROM _search_part)").replace("p_name[-1]", "substr(p_name, -1)")).withColumnRenamed("q", "query")
    entries = p.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("term"), (1 - F.col("id") % 3 * 0.1).alias("weight"))
    return lexicon.search(queries, "query", "t", entries, "id", "term", "weight", limit=5)
