import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexicon as L


def norm(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()


def brute_matches(docs, terms):
    out = set()
    for key, text in docs:
        w = norm(text).split()
        for term, id_ in terms:
            t = norm(term).split()
            out |= {(key, i, i + len(t), id_, len(" ".join(t))) for i in range(len(w) - len(t) + 1) if t and w[i : i + len(t)] == t}
    return out


def brute_spans(found):
    kept = {}
    for key, start, end, id_, chars in sorted(found, key=lambda m: (-m[4], m[1], m[3])):
        own = kept.setdefault(key, [])
        if all(end <= s or start >= e for s, e, _ in own):
            own.append((start, end, id_))
    return {(k, *x) for k, v in kept.items() for x in v}


@pytest.mark.parametrize("few", [100_000, 3])
def test_spans_by_force(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    rng = random.Random(1)
    word = lambda: rng.choice("a b c dd ee fff the of".split())
    terms = [(" ".join(word() for _ in range(rng.randrange(1, 5))), k) for k in range(40)] + [("The  OF!", 90), ("the of", 91), ("", 92), (None, 93), ("a a", 94)]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(20)] + [(50, None), (51, "A; a--A a,a"), (52, "dd " * 400)]
    df, lex = spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame(terms, "term string, id int")
    found = L.matches(df, "k", "t", lex, "term", "id")
    expected = brute_matches(docs, terms)
    assert sorted((r.k, r.start, r.end, r.id, r.chars) for r in found.collect()) == sorted(expected)
    assert {tuple(r) for r in L.longest_spans(found, "k", "id").collect()} == brute_spans(expected)


def test_the_longest_wins_whatever_it_overlaps(spark):
    lex = spark.createDataFrame([("chronic fatigue", 1), ("fatigue syndrome research group", 2), ("syndrome", 3), ("chronic", 4)], "term string, id int")
    docs = spark.createDataFrame([(1, "Chronic fatigue syndrome research group; chronic fatigue.")], "k int, t string")
    got = {(r.start, r.end, r.id) for r in L.longest_spans(L.matches(docs, "k", "t", lex, "term", "id"), "k", "id").collect()}
    assert got == {(1, 5, 2), (0, 1, 4), (5, 7, 1)}


ENTRIES = [(1, "Chronic fatigue syndrome", 1.0), (1, "CFS", 0.9), (2, "Long COVID", 1.0), (2, "Post-COVID conditions", 0.95), (3, "Fibromyalgia", 1.0), (4, "Postural orthostatic tachycardia syndrome", 1.0), (4, "POTS", 1.0), (5, "Pots and pans", 0.8), (6, "Flu", 1.0), (7, "long covid", 0.9)]


def ask(spark, *texts, **how):
    queries = spark.createDataFrame(list(enumerate(texts)), "q long, t string")
    found = L.search(queries, "q", "t", spark.createDataFrame(ENTRIES, "id int, term string, w double"), "id", "term", "w", **how)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.q, r.place)):
        out.setdefault(texts[r.q], []).append((r.id, r.score, r.how))
    return out


def test_search_by_exact_subset_and_spelling(spark):
    got = ask(spark, "post covid condition", "fatigue chronic", "the long covid thing", "Fibromyalga", "POTS", "pots", "cfs", "COVID", "flu", "flux", "  ", "nothing like it", "postural orthostatic tachycardia syndrom")
    assert got["post covid condition"][0] == (2, 0.95, "exact")
    assert got["fatigue chronic"] == [(1, 0.8, "subset")]
    assert got["the long covid thing"] == [(2, 0.8, "subset"), (7, 0.72, "subset")]
    assert got["Fibromyalga"] == [(3, pytest.approx(0.75 * 22 / 23, abs=1e-4), "spelling")]
    assert got["POTS"] == [(4, 1.0, "exact")]  # an acronym: neither part of another entry nor close to one
    assert got["pots"] == [(4, 1.0, "exact")] and got["cfs"] == [(1, 0.9, "exact")]
    assert got["COVID"] == [] if "COVID" in got else True
    assert got["flu"] == [(6, 1.0, "exact")] and "flux" not in got and "  " not in got and "nothing like it" not in got
    assert got["postural orthostatic tachycardia syndrom"][0][::2] == (4, "spelling")
    assert len(ask(spark, "long covid", limit=1)["long covid"]) == 1


def test_spelling_pairs_by_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 30))).strip() or "x" for _ in range(60)]
    changed = []
    for b in base * 3:
        s = list(b)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = [rng.choice("abcde")] if rng.random() < 0.6 else []
        changed.append(("".join(s).strip()) or "y")
    q, e = spark.createDataFrame(list(enumerate(changed)), "_q long, _qs string"), spark.createDataFrame(list(enumerate(base)), "_e long, _es string")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    expected = {(i, j) for i, x in enumerate(changed) for j, y in enumerate(base) if 200 * lcs(x, y) >= 88 * (len(x) + len(y))}
    assert {(r._q, r._e) for r in L.spelled(q, e, 88).collect()} == expected and len(expected) > 60
    assert all(L.indel(x, y) == len(x) + len(y) - 2 * lcs(x, y) for x in changed[:20] for y in base[:20])


def test_normalised_tells_matched_from_ambiguous_partial_and_unknown(spark):
    queries = spark.createDataFrame([(0, "Chronic Fatigue Syndromes"), (1, "tachycardia syndrome postural"), (2, "zebra"), (3, "cold")], "q long, t string")
    entries = spark.createDataFrame([*ENTRIES, (8, "cold", 1.0), (9, "Colds", 1.0)], "id int, term string, w double")
    got = {r.q: (r.status, r.ids) for r in L.normalised(queries, "q", "t", entries, "id", "term", "w").collect()}
    assert got == {0: ("matched", [1]), 1: ("partial", [4]), 2: ("unknown", None), 3: ("ambiguous", [8, 9])}


def test_acronyms(spark):
    df = spark.createDataFrame([(t,) for t in ("POTS", "hEDS", "ME/CFS", "Flu", "ME CFS", "LONGNAME", " AB ", "")], "t string")
    assert [r.a for r in df.select(L.is_acronym(F.col("t")).alias("a")).collect()] == [True, True, True, False, False, False, True, False]


def test_search_makes_its_keys_once_for_each_text(spark):
    """Else filters on keys are worked out for every row below the grouping of queries and entries."""
    queries = spark.createDataFrame([(k, "long covid" if k % 2 else "flu") for k in range(8)], "q long, t string").groupBy("t").agg(F.min("q").alias("q"))
    entries = spark.createDataFrame(ENTRIES * 3, "id int, term string, w double").groupBy("id", "term").agg(F.max("w").alias("w"))
    found = L.search(queries, "q", "t", entries, "id", "term", "w")
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.q, r.id, r.score) for r in found.collect()} == {(1, 2, 1.0), (1, 7, 0.9), (0, 6, 1.0)}


def test_spans_look_for_terms_of_the_same_words_once(spark, monkeypatch):
    looked, real = [], L.matches
    monkeypatch.setattr(L, "matches", lambda docs, key, text, lexicon, *rest: looked.append(lexicon.count()) or real(docs, key, text, lexicon, *rest))
    terms = [("the", k) for k in range(9, 4, -1)] + [("THE!", 3), ("of the", 8), ("of  the", 7), ("", 1), (None, 2)]
    docs = [(1, "the end of the the"), (2, None), (3, "of")]
    got = {tuple(r) for r in L.spans(spark.createDataFrame(docs, "k int, t string"), "k", "t", spark.createDataFrame(terms, "term string, id int"), "term", "id").collect()}
    assert got == brute_spans(brute_matches(docs, terms)) == {(1, 0, 1, 3), (1, 2, 4, 7), (1, 4, 5, 3)} and looked == [2]
