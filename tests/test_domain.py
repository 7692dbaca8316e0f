import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import entity, governance, scoring, statistics, text
from lodestone.operators import timeseries as T


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_names(spark):
    name = lambda v: " ".join(one(spark, v, "string", S.name_tokens))
    assert name("St. Luke's Hosp.") == "saint lukes hospital"
    assert name("The Mayo Clinic, Inc.") == "mayo clinic"


def test_codes(spark):
    assert [one(spark, v, "string", S.icd_category) for v in ("I73.00", "G9332", "u09.9", "", None)] == ["I73", "G93", "U09", None, None]
    assert [one(spark, v, "string", S.luhn_npi) for v in ("1234567893", "1234567890", "", "abc", None)] == [True, False, False, False, False]
    assert one(spark, "2363", "string", S.verhoeff_ok) and not one(spark, "2364", "string", S.verhoeff_ok)


def test_age_bands(spark):
    assert [one(spark, v, "double", S.age_band) for v in (3.0, 44.0, 79.9, 80.0, 85.0, 95.0, None)] == ["0-9", "40-49", "70-79", "80-89", "80-89", "90+", None]
    assert one(spark, 85.0, "double", lambda x: S.age_band(x, 80)) == "80+"


def test_margins(spark):
    row = spark.createDataFrame([(10.0, 0.0, 0.0, 3.0, 4.0, 5.0)], "a double, b double, c double, x double, y double, z double")
    got = row.select(S.moe_sum([F.col("a"), F.col("b"), F.col("c")], [F.col("x"), F.col("y"), F.col("z")]).alias("m"), S.moe_proportion(F.lit(20.0), F.lit(5.0), F.lit(100.0), F.lit(10.0)).alias("p")).first()
    assert got.m == pytest.approx(math.sqrt(34)) and got.p == pytest.approx(math.sqrt(21) / 100)


def test_size_class(spark):
    assert [one(spark, v, "string", S.size_class) for v in ("size class 1,000-4,999", "10,000+", None)] == [2236, 10000, None]


def test_refused_values(spark):
    assert [one(spark, v, "string", S.refused_value) for v in ("a@b.org", "123-45-6789", "(555) 123-4567", "2024-01-31", "12345-6789", "12345", None)] == ["email", "ssn", "phone", "date", "zip", None, None]


def test_survey_toy(spark):
    data = [(1, 1, 1.0, 1.0), (1, 1, 2.0, 0.0), (1, 2, 1.0, 1.0), (2, 1, 2.0, 1.0), (2, 2, 2.0, 0.0), (2, 2, 1.0, 0.0)]
    df = spark.createDataFrame([(*r, i != 5) for i, r in enumerate(data)], "h int, j int, w double, y double, d boolean")
    got = statistics.taylor_mean(df, "y", "w", "h", "j").first()
    assert got.estimate == pytest.approx(4 / 9) and got.se == pytest.approx(math.sqrt(548) / 81) and got.df == 2
    got = statistics.taylor_mean(df, "y", "w", "h", "j", F.col("d")).first()
    assert got.estimate == pytest.approx(0.5) and got.se == pytest.approx(math.sqrt(5) / 8)


def test_adjusted_p_values(spark):
    p = lambda v: spark.createDataFrame(list(enumerate(v)), "i int, p double")
    holm = [r.q for r in statistics.holm_adjust(p([0.01, 0.04, 0.03, None]), "p", "i", "q").orderBy("i").collect()]
    assert holm == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06), None]
    bh = [r.q for r in statistics.bh_adjust(p([0.01, 0.04, 0.03, 0.5, None]), "p", "i", "q").orderBy("i").collect()]
    assert bh == [pytest.approx(0.04), pytest.approx(0.16 / 3), pytest.approx(0.16 / 3), 0.5, None]


def test_auroc_and_sensitivity(spark):
    df = spark.createDataFrame([(float(i), int(i >= 180)) for i in range(200)], "s double, y int")
    assert statistics.auroc(df, "s", "y").first().auroc == 1.0
    assert statistics.sens_at_spec(df, "s", "y", 0.9).first().sensitivity == 1.0


def test_between_group_sd(spark):
    df = spark.createDataFrame([(float(i), 0.0, 10.0) for i in range(1, 5)], "v double, a double, b double")
    assert df.agg(scoring.between_group_sd(F.col("v"), F.col("a"))).first()[0] == pytest.approx(math.sqrt(5 / 3))
    assert df.agg(scoring.between_group_sd(F.col("v"), F.col("b"))).first()[0] == 0.0


def test_composite_drops_missing_weight(spark):
    df = spark.createDataFrame([(None, 0.5), (1.0, 0.0)], "b double, v double")
    got = [r[0] for r in df.select(scoring.weighted_composite({"b": F.col("b"), "v": F.col("v")}, {"b": 1, "v": 1})).collect()]
    assert got == [0.5, 0.5]


def test_rhythm(spark):
    df = spark.createDataFrame([("p", i, float(x)) for i, x in enumerate([0, 2, 2, 4])], "id string, e int, x double")
    assert T.rhythm_stability(df, "id", "e", "x", 2).first().stability == pytest.approx(0.5)
    df = spark.createDataFrame([("p", i, float(x)) for i, x in enumerate([1, 2, 3, 4])], "id string, e int, x double")
    assert T.rhythm_variability(df, "id", "e", "x").first().variability == pytest.approx(0.8)


def test_bouts(spark):
    df = spark.createDataFrame([("p", i, bool(s)) for i, s in enumerate([1, 1, 0, 0, 0, 1, 0, 1, 1, 1])], "id string, i int, s boolean")
    got = T.bouts(df, "id", "i", F.col("s"), F.lit(True)).orderBy("start").collect()
    assert [r.length for r in got if r.state] == [2, 1, 3] and [r.length for r in got if not r.state] == [3, 1]


def test_circular_mean(spark):
    mean, _ = T.circular_mean_hours(F.col("h"))
    near = lambda v: spark.createDataFrame([(x,) for x in v], "h double").agg(mean.alias("m")).first().m
    assert min(near([23.0, 1.0]), 24 - near([23.0, 1.0])) < 1e-6 and near([23.0, 23.5]) == pytest.approx(23.25)


def test_nonwear_allows_two_spikes(spark):
    def worn(spike):
        c = [0] * 90
        c[30 : 30 + spike] = [5] * spike
        df = spark.createDataFrame([("p", i, x) for i, x in enumerate(c)], "id string, m long, c long")
        return T.nonwear(df, "id", "m", "c", 60, 2).filter("worn").count()

    assert worn(2) == 0 and worn(3) == 90


def test_cusum_needs_a_baseline(spark):
    calm = [("a", i, 60.0 + i % 3) for i in range(28)]
    df = spark.createDataFrame(calm + [("b", i, 60.0 + i % 3) for i in range(28)] + [("b", 28 + i, 70.0) for i in range(5)], "id string, d long, x double")
    assert {r.id for r in T.cusum_alarms(df, "id", "d", "x").collect()} == {"b"}


def test_components_and_clusters(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (5, 6, 0.7)], "a long, b long, conf double")
    assert sorted(map(tuple, entity.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    nodes = spark.createDataFrame([(1, "u"), (2, "x"), (3, "u"), (5, "x"), (6, "x"), (9, "x")], "id long, kind string")
    assert sorted(map(tuple, entity.constrained_clusters(nodes, edges, "u").collect())) == [(1, 1), (2, 1), (3, 3), (5, 5), (6, 5), (9, 9)]


def test_token_ratios():
    assert entity.token_sort_ratio("mercy general", "general mercy") == 100.0
    assert entity.token_set_ratio("mercy hospital", "mercy hospital west") == 100.0
    assert entity.token_sort_ratio("", "") == 100.0


def test_quote_sources(spark):
    q = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "not there at all my friend")], "id int, t string")
    d = spark.createDataFrame([(1, "see: the QUICK, brown fox  jumps high"), (2, None)], "sid int, t string")
    assert sorted(map(tuple, text.quote_sources(q, "id", "t", d, "sid", "t").collect())) == [(1, 1), (2, 0)]


def test_contract_and_provenance(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "id int, v string")
    got = {r.rule: r.broken for r in governance.contract(df, {"v known": F.col("v").isin("a")}, ["id"]).collect()}
    assert got == {"v known": 1, "id unique": 1}
    with pytest.raises(ValueError):
        governance.require_provenance(df)


def test_phenotype_refuses_unknown_transform():
    with pytest.raises(ValueError):
        scoring.load_phenotype('{"intercept": 0, "threshold": 0, "features": [{"transform": "cube"}]}')


def test_fuzzy_edges_at_exactly_the_bound(spark):
    names = spark.createDataFrame([(1, "abcdefghij", 0), (2, "bcdefghija", 0), (3, "cdefghijab", 0)], "k long, name string, g int")
    got = entity.fuzzy_edges(names, "k", "name", ["g"], 90.0).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 90.0), (2, 3, 90.0)]
