import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregates, joins, ranking, reshape


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_percentile_rank_averages_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, None), (3, 2.0), (4, 2.0)], "i int, x double")
    assert [r[1] for r in rows(ranking.percentile_rank(df, "x", "p").select("i", "p"), "i")] == [1.0, 0.25, None, 0.625, 0.625]


def test_reference_percentile_adds_outsiders(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, True), (3.0, True), (2.0, False), (10.0, False)], "x double, r boolean")
    got = {(r.x, r.r): r.p for r in ranking.ref_percentile(df, "x", "r", "p").collect()}
    assert got[(1.0, True)] == 0.25 and got[(2.0, True)] == 0.625 and got[(2.0, False)] == 0.6 and got[(10.0, False)] == 1.0


def test_rank_eligible_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 0.5, True), (2, 0.9, True), (3, 0.5, True), (4, None, True), (5, 0.95, False)], "id int, s double, e boolean")
    assert [r[1] for r in rows(ranking.rank_eligible(df, "s", F.col("e"), ["id"], "rn").select("id", "rn"), "id")] == [2, 1, 3, None, None]


def test_topn_inclusion_shares_the_border(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.0), (3, 2.0), (4, 1.0)], "id int, s double")
    got = [r[1] for r in rows(ranking.topn_inclusion(df, "s", 2, "p").select("id", "p"), "id")]
    assert got == [1.0, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), 0.0]


def test_null_safe_join_matches_nulls(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(None, "c"), (2, "d")], "k int, y string")
    assert rows(joins.null_safe_join(a, b, ["k"]), "x") == [(None, "b", "c")]


def test_row_diff_counts(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    b = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, x string")
    assert rows(joins.row_diff(a, b, ["k"]), "same") == [(1, 1, 1, 1)]


def test_one_to_one_refuses_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        joins.one_to_one(a, a, ["k"])


def test_radius_join_keeps_the_near_point(spark):
    a = spark.createDataFrame([(40.0, -100.0)], "alat double, alon double")
    b = spark.createDataFrame([(40.0, -100.0), (40.3, -100.0), (41.0, -100.0)], "blat double, blon double")
    assert [r.blat for r in joins.radius_join(a, b, ("alat", "alon"), ("blat", "blon"), 50.0).orderBy("blat").collect()] == [40.0, 40.3]


def test_radius_join_wraps_at_the_date_line_and_poles(spark):
    a = spark.createDataFrame([(0.0, 179.9), (89.9, 10.0)], "alat double, alon double")
    b = spark.createDataFrame([(0.0, -179.9), (89.9, -170.0)], "blat double, blon double")
    assert joins.radius_join(a, b, ("alat", "alon"), ("blat", "blon"), 50.0).count() == 2


def test_asof_pick_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("u", 5, 10), ("u", 3, 11), ("u", 6, 12)], "k string, t int, ref int")
    assert rows(joins.asof_pick(left, right, "k", "t", "t", "ref", ["ref"]).select("id", "ref"), "id") == [(1, 10), (2, None), (3, None)]


def test_parent_child_sum(spark):
    df = spark.createDataFrame([(1, "p", False, 110.0), (1, "p", False, 110.0), (2, "p", True, 50.0), (3, "q", True, 100.0), (4, "q", True, 7.0)], "id int, k string, child boolean, a double")
    assert rows(aggregates.parent_child_sum(df, ["k"], "child", "a", "id"), "k") == [("p", 110.0), ("q", 107.0)]


def test_suppress_hides_one_more(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 20), ("g", 3, 30), ("h", 1, 40), ("h", 2, 50)], "g string, c int, n int")
    got = {(r.g, r.c): r.shown for r in aggregates.suppress(df, ["g"], "c", "n", 10).collect()}
    assert got == {("g", 1): None, ("g", 2): None, ("g", 3): 30, ("h", 1): 40, ("h", 2): 50}


def test_weighted_quantile_interpolates(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0), ("a", None, 5.0)], "g string, x double, w double")
    assert aggregates.weighted_quantile(df, ["g"], "x", "w", 0.5, "q").first().q == pytest.approx(2 + 0.125 / 0.375)


def test_union_drift_finds_the_common_type(spark):
    a = spark.createDataFrame([(1, 1)], "id int, x int")
    b = spark.createDataFrame([(2, "z")], "id int, x string")
    c = spark.createDataFrame([(3, 0.5)], "id int, y double")
    got = reshape.union_drift([a, b, c])
    assert dict(got.dtypes) == {"id": "int", "x": "string", "y": "double"}
    assert rows(got, "id") == [(1, "1", None), (2, "z", None), (3, None, 0.5)]


def test_table_hash_ignores_order_but_not_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(2, 3), (1, None)], "x int, y int")
    c = spark.createDataFrame([(None, 1), (2, 3)], "x int, y int")
    h = lambda df: aggregates.table_hash(df).first().hash
    assert h(a) == h(b) != h(c)


def test_mutual_best(spark):
    e = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.95), (2, 11, 0.1)], "a int, b int, s double")
    assert rows(ranking.mutual_best(e, "a", "b", "s").select("a", "b"), "a") == [(2, 10)]
