import os

import pytest
from pyspark.sql import functions as F

import lodestone.plans as plans
from lodestone.operators import contrasts

DIR = "/root/testdata/sf0.001"


def test_kendall_w_of_equal_and_reversed_rankings(spark):
    same = spark.createDataFrame([(r, o, float(o)) for r in range(3) for o in range(1, 5)], "rater int, item int, r double")
    assert contrasts.kendall_w(same, "rater", "item", "r").first().w == pytest.approx(1.0)
    turned = spark.createDataFrame([(0, o, float(o)) for o in range(1, 5)] + [(1, o, float(5 - o)) for o in range(1, 5)], "rater int, item int, r double")
    assert contrasts.kendall_w(turned, "rater", "item", "r").first().w == pytest.approx(0.0)


def test_mann_whitney_counts_pairs_with_ties_as_half(spark):
    df = spark.createDataFrame([("k", 1.0, True), ("k", 2.0, True), ("k", 2.0, False), ("k", 3.0, False), ("k", None, True)], "k string, x double, g boolean")
    r = contrasts.mann_whitney(df, ["k"], "x", F.col("g")).first()
    assert (r.n1, r.n0, r.u) == (2, 2, 0.5)


def test_welch_is_null_with_a_group_of_one(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False), ("a", 3.0, False), ("b", 1.0, True), ("b", 3.0, True), ("b", 5.0, False), ("b", 7.0, False)], "k string, x double, g boolean")
    got = {r.k: r for r in contrasts.welch_t(df, ["k"], "x", F.col("g")).collect()}
    assert got["a"].t is None
    assert got["b"].t == pytest.approx(-4 / 2**0.5) and got["b"].df == pytest.approx(2.0)


def test_youden_takes_the_smallest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, True), (3.0, False), (4.0, True)], "s double, y boolean")
    r = contrasts.youden(df, [], "s", F.col("y")).first()
    assert (r.threshold, r.j) == (2.0, 0.5)


def test_precision_at_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, 5.0, 0), (3, 1.0, 1), (4, None, 1)], "id int, s double, y int")
    got = {r.k: (r.hits, r.precision) for r in contrasts.precision_at(df, "s", F.col("y") == 1, ["id"], [1, 2, 9]).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.5), 9: (2, pytest.approx(2 / 3))}


def test_log_cpm_and_best_probe(spark):
    df = spark.createDataFrame([("s", "f", 1), ("s", "g", 3), ("t", "f", 0)], "sample string, feature string, n int")
    got = {(r.sample, r.feature): r.log_cpm for r in contrasts.log_cpm(df, "sample", "feature", "n").collect()}
    assert got[("t", "f")] is None and 2 ** got[("s", "f")] == pytest.approx(250001)
    probes = spark.createDataFrame([("x", "p2", 2.0), ("x", "p1", 2.0), ("x", "p3", 1.0)], "symbol string, probe string, v double")
    assert contrasts.best_probe(probes, "symbol", "probe", "v").first().probe == "p1"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_ancestors_end_at_the_root(spark):
    got = {(r.node, r.ancestor) for r in plans.QUERIES["ancestor_closure"](spark, DIR).filter("node IN (5, 21)").collect()}
    assert got == {(5, 1), (21, 5), (21, 1)}
