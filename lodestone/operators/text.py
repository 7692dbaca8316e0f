"""Text mining on columns: mentions, lexicon lookups, quotes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import norm_text


def mentions(df: DataFrame, key: str, text: str, include: str, exclude: str) -> DataFrame:
    """First hit of a pattern, after what the excluding pattern matches is blanked."""
    bare = F.regexp_replace(text, exclude, " ")
    return df.select(key, F.lower(F.regexp_extract(bare, include, 0)).alias("mention")).filter("mention <> ''")


def resolve(df: DataFrame, query: str, lexicon: DataFrame) -> DataFrame:
    """Exact lookup of normalised terms in lexicon (term, id, sense): how is exact, ambiguous (several senses, no id) or unknown."""
    keys = lexicon.groupBy(norm_text(F.col("term")).alias("_k")).agg(F.min("id").alias("_id"), F.countDistinct("sense").alias("_n"))
    out = df.withColumn("_k", norm_text(F.col(query))).join(keys, "_k", "left")
    how = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("exact")
    return out.withColumn("id", F.when(F.col("_n") == 1, F.col("_id"))).withColumn("how", how).drop("_k", "_id", "_n")


def quote_sources(quotes: DataFrame, qid: str, quote: str, sources: DataFrame, sid: str, text: str, words: int = 5) -> DataFrame:
    """How many sources hold each quote, normalised.

    A quote's first words are the join key to every place of a source, so that it is an equi-join; `contains` verifies.
    Quotes of fewer words are looked up by what they have.
    """
    q = quotes.select(F.col(qid), norm_text(F.col(quote)).alias("_q")).withColumn("_w", F.split("_q", " "))
    q = q.withColumn("_n", F.least(F.size("_w"), F.lit(words))).withColumn("_k", F.array_join(F.slice("_w", F.lit(1), F.col("_n")), " "))
    lengths = [r[0] for r in q.select("_n").distinct().collect()]
    s = sources.select(F.col(sid), norm_text(F.col(text)).alias("_t")).withColumn("_sw", F.split("_t", " "))
    keys = None
    for n in lengths:
        part = s.select(sid, F.explode(F.array_distinct(_grams(n))).alias("_k"))
        keys = part if keys is None else keys.union(part)
    if keys is None:
        return quotes.select(qid, F.lit(0).cast("long").alias("n_sources"))
    hits = keys.join(F.broadcast(q.select("_k").distinct()), "_k", "left_semi") if q.count() <= 10_000 else keys
    found = q.join(hits.distinct(), "_k").join(s.select(sid, "_t"), sid).filter(F.contains(F.col("_t"), F.col("_q")))
    counts = found.groupBy(qid).agg(F.countDistinct(sid).alias("n_sources"))
    return quotes.select(qid).distinct().join(counts, qid, "left").select(qid, F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def _grams(n: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size("_sw") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(F.col("_sw"), i, F.lit(n)), " "))
