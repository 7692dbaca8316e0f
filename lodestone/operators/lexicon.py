"""Terms of a lexicon in texts, and lexicon entries for a query: longest spans, exact, subset and spelling matches."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import compact_key, norm_text, singular_key
from lodestone.sources.shared import saved

#: Up to so many terms go to every task; a larger lexicon is joined by shuffle.
FEW = 100_000


def words(text: Column) -> Column:
    """Normalised words; none for null."""
    return F.filter(F.split(F.coalesce(norm_text(text), F.lit("")), " "), lambda w: w != "")


def _anchored(lexicon: DataFrame, term: str, id_: str) -> DataFrame:
    """id, term (its words), chars, anchor (the word that fewest terms have, then the longest) and off (its place)."""
    terms = lexicon.select(F.col(id_).alias("_id"), words(F.col(term)).alias("_term")).filter("size(_term) > 0").distinct()
    each = terms.select("_id", "_term", F.posexplode("_term").alias("_off", "_anchor"))
    rare = each.select("_term", "_anchor").distinct().groupBy("_anchor").agg(F.count("*").alias("_n"))
    best = F.min(F.struct("_n", -F.length("_anchor"), "_anchor", "_off")).alias("_b")
    picked = each.join(rare, "_anchor").groupBy("_id", "_term").agg(best)
    return picked.select("_id", "_term", F.length(F.array_join("_term", " ")).alias("_chars"), F.col("_b._anchor").alias("_anchor"), F.col("_b._off").alias("_off"))


def matches(docs: DataFrame, key: str, text: str, lexicon: DataFrame, term: str, id_: str) -> DataFrame:
    """key, start, end (words of the normalised text, end not included), id, chars: every place where a term's words stand one after another.

    Only a term's rarest word is looked for; the words about it are compared where it stands.  key tells documents apart.
    """
    lex = _anchored(lexicon, term, id_)
    texts = docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("_words"))
    at = texts.select("_key", "_words", F.posexplode("_words").alias("_pos", "_anchor"))
    if len(lexicon.limit(FEW + 1).select(F.lit(1)).collect()) <= FEW:
        met = at.join(F.broadcast(lex), "_anchor")
    else:  # places travel without their texts
        met = at.select("_key", "_pos", "_anchor").join(lex, "_anchor").join(texts, "_key")
    start = F.col("_pos") - F.col("_off")
    same = (start >= 0) & (F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.size("_term")) == F.col("_term"))
    return met.filter(same).select(F.col("_key").alias(key), start.alias("start"), (start + F.size("_term")).alias("end"), F.col("_id").alias(id_), F.col("_chars").alias("chars"))


def longest_spans(found: DataFrame, key: str, id_: str) -> DataFrame:
    """Of matches (key, start, end, id, chars) those that stay when the longest are taken first, then the earliest, then the smallest id, and none overlaps one taken.

    Runs of matches that overlap one another are chosen from each for itself, so a long text is no long list.
    """
    w = Window.partitionBy(key).orderBy("start", "end", id_)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = F.sort_array(F.collect_list(F.struct((-F.col("chars")).alias("n"), "start", F.col(id_).alias("id"), "end")))
    listed = rows.groupBy(key, "_run").agg(spans.alias("_s"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (x["start"] < t["end"]) & (t["start"] < x["end"]))
    kept = F.aggregate("_s", F.slice("_s", F.lit(1), F.lit(0)), lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return listed.select(key, F.explode(kept).alias("_t")).select(key, "_t.start", "_t.end", F.col("_t.id").alias(id_))


def spans(docs: DataFrame, key: str, text: str, lexicon: DataFrame, term: str, id_: str) -> DataFrame:
    """longest_spans of all matches: key, start, end, id.

    Of terms with the same words only the smallest id can stay, so only that one is looked for.
    """
    same = lexicon.select(F.array_join(words(F.col(term)), " ").alias(term), id_).filter(F.col(term) != "").groupBy(term).agg(F.min(id_).alias(id_))
    return longest_spans(matches(docs, key, text, same, term, id_), key, id_)


def is_acronym(text: Column) -> Column:
    """At most seven characters without a space, at least two of them capitals."""
    t = F.trim(text)
    return ~t.contains(" ") & F.length(t).between(1, 7) & (F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) >= 2)


def indel(a: str, b: str) -> int:
    """Insertions and deletions that turn a into b: what their longest common subsequence leaves, by bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


def _close(batches):
    """Adds the share of letters, in hundredths, that two texts have in common in order."""
    for batch in batches:
        a, b = batch.column("_qs").to_pylist(), batch.column("_es").to_pylist()
        ratio = [100.0 * (1 - indel(x, y) / (len(x) + len(y))) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_q", "_e")), pa.array(ratio, pa.float64())], ["_q", "_e", "ratio"])


def _grams(text: Column) -> Column:
    """Pairs of neighbouring letters, each with how often it came before, so that sets count what lists hold."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) > 1, F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda h: h == g)).cast("string")))).otherwise(F.array(text))


def spelled(queries: DataFrame, entries: DataFrame, least: int, by: list[str] | None = None) -> DataFrame:
    """queries (_q, _qs), entries (_e, _es) -> _q, _e, ratio of pairs, of equal `by`, whose texts agree to `least` hundredths.

    Texts of m and n letters at a distance of d have (m + n) / 2 - 1 - 3 d / 2 pairs of neighbouring letters in common at least: what they have in common loses a pair and gains
    one at every letter that is put in or taken out.  So close ones share one of the rarest few of either, and only these are joined.
    """
    by, rest = by or [], 100 - least
    allowed = lambda n: F.floor(F.lit(4 * rest) * n / (100 + rest))  # noqa: E731  how many pairs of letters a text may lack in a close one, at its shortest
    q = queries.select("_q", "_qs", *by, F.length("_qs").alias("_ql"), _grams(F.col("_qs")).alias("_g"))
    e = entries.select("_e", "_es", *by, F.length("_es").alias("_el"), _grams(F.col("_es")).alias("_g"))
    count = e.select(F.explode("_g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(side: DataFrame, id_: str, text: str, size: str) -> DataFrame:
        each = side.select(id_, text, size, *by, F.explode("_g").alias("gram")).join(count, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        listed = each.groupBy(id_, text, size, *by).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("_g"))
        return listed.select(id_, text, size, *by, F.explode(F.slice("_g", F.lit(1), (allowed(F.col(size)) + 1).cast("int"))).alias("g")).select(id_, text, size, *by, "g.gram")

    near = F.abs(F.col("_ql") - F.col("_el")) * 100 <= (F.col("_ql") + F.col("_el")) * rest
    pairs = rarest(q, "_q", "_qs", "_ql").join(rarest(e, "_e", "_es", "_el"), ["gram", *by]).filter(near).select("_q", "_e", "_qs", "_es").distinct()
    return pairs.mapInArrow(_close, "_q long, _e long, ratio double").filter(F.col("ratio") >= least - 1e-9)


def search(queries: DataFrame, query: str, text: str, lexicon: DataFrame, id_: str, term: str, weight: str, limit: int = 10, least_score: float = 0.6, least_ratio: int = 88) -> DataFrame:
    """queries (query: long, text), lexicon (id, term, weight) -> query, id, score, how, term, place: for each query its best entries, one row for each id.

    A score is the weight times 1 for the same text but for punctuation, spaces and plurals (`exact`); 0.8 if all words of one are words of the other and at least half of
    these (`subset`; an entry within a query needs a word of four letters); 0.75 times the share of letters in common, the words sorted, if that is at least
    least_ratio hundredths (`spelling`).  Acronyms, on either side, match exactly only.  Of an id's entries the best counts, of equal ones the smallest term.

    Entries are found by keys: their exact key, the rarest word of whichever is the subset, the rarest pairs of letters.  Nothing is scored against all entries.
    """
    q = queries.select(F.col(query).cast("long").alias("_q"), F.col(text).alias("_t"))
    e = lexicon.select(F.col(id_).alias("_id"), F.col(term).alias("_term"), F.col(weight).cast("double").alias("_w")).groupBy("_id", "_term").agg(F.max("_w").alias("_w"))
    number = F.xxhash64("_id", "_term")

    def keyed(df: DataFrame, t: str) -> DataFrame:
        kept = F.filter(F.array_distinct(F.split(singular_key(F.col(t)), " ")), lambda w: w != "")
        return df.withColumn("compact", compact_key(F.col(t))).withColumn("singular", singular_key(F.col(t))).withColumn("acronym", is_acronym(F.col(t))).withColumn("tokens", kept).withColumn("sorted", F.array_join(F.array_sort(F.filter(F.split(norm_text(F.col(t)), " "), lambda w: w != "")), " "))

    # keys are made once for each text and written; filters on them would else be worked out for every row that a grouping above has yet to gather
    q, e = saved(keyed(q, "_t"), "queries").filter(F.length(F.trim("_t")) > 0), saved(keyed(e.withColumn("_e", number), "_term"), "entries").filter("sorted <> ''")
    plain_q, plain_e = q.filter("NOT acronym AND size(tokens) > 0"), e.filter("NOT acronym")
    found = lambda df, score, how: df.select("_q", "_e", (score * F.lit(1.0)).alias("share"), F.lit(how).alias("how"))
    exact = q.select("_q", "compact").filter("compact <> ''").join(e.select("_e", "compact"), "compact")
    plural = plain_q.select("_q", "singular").join(plain_e.select("_e", "singular"), "singular")
    token_n = plain_e.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, k: str) -> DataFrame:
        each = df.select(k, "tokens", F.explode("tokens").alias("token")).join(token_n, "token", "left")
        return each.groupBy(k, "tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("r")).select(k, "tokens", F.col("r.token").alias("token"))

    inside = rarest(plain_q, "_q").select("_q", F.col("tokens").alias("a"), "token").join(plain_e.select("_e", F.col("tokens").alias("b"), F.explode("tokens").alias("token")), "token")
    around = rarest(plain_e.filter(F.exists("tokens", lambda w: F.length(w) >= 4)), "_e").select("_e", F.col("tokens").alias("a"), "token").join(plain_q.select("_q", F.col("tokens").alias("b"), F.explode("tokens").alias("token")), "token")
    subset = (F.size(F.array_except("a", "b")) == 0) & (2 * F.size("a") >= F.size("b"))
    close = spelled(plain_q.filter("sorted <> ''").select("_q", F.col("sorted").alias("_qs")), plain_e.select("_e", F.col("sorted").alias("_es")), least_ratio)
    every = found(exact, F.lit(1.0), "exact").union(found(plural, F.lit(1.0), "exact")).union(found(inside.filter(subset), F.lit(0.8), "subset")).union(found(around.filter(subset), F.lit(0.8), "subset"))
    every = every.union(found(close, 0.75 * F.col("ratio") / 100, "spelling"))
    scored = every.groupBy("_q", "_e").agg(F.max(F.struct("share", "how")).alias("s")).join(e.select("_e", "_id", "_term", "_w"), "_e").withColumn("score", F.col("s.share") * F.col("_w")).filter(F.col("score") >= least_score - 1e-12)
    best = scored.groupBy("_q", "_id").agg(F.min(F.struct((-F.col("score")).alias("n"), F.col("_term").alias("term"), F.col("s.how").alias("how"))).alias("b"))
    w = Window.partitionBy("_q").orderBy(F.round("b.n", 9), "_id")
    ranked = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    return ranked.select(F.col("_q").alias(query), F.col("_id").alias(id_), F.round(-F.col("b.n"), 4).alias("score"), F.col("b.how").alias("how"), F.col("b.term").alias(term), "place")


def normalised(queries: DataFrame, query: str, text: str, lexicon: DataFrame, id_: str, term: str, weight: str, good: float = 0.7, sure: float = 0.9) -> DataFrame:
    """query, status, ids (sorted): `matched` for one best entry with a score of `sure` at least, `ambiguous` for several, `partial` below, `unknown` without one of `good`."""
    found = search(queries, query, text, lexicon, id_, term, weight, limit=1 << 30).filter(F.col("score") >= good)
    best = found.groupBy(query).agg(F.max("score").alias("top")).join(found, query).filter("score = top").groupBy(query, "top").agg(F.sort_array(F.collect_set(id_)).alias("ids"))
    status = F.when(F.col("ids").isNull(), "unknown").when(F.col("top") < sure, "partial").when(F.size("ids") > 1, "ambiguous").otherwise("matched")
    return queries.select(query).distinct().join(best, query, "left").select(query, status.alias("status"), "ids")
