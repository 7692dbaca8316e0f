import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import moran as M
from lodestone.operators import selection as S
from tests.test_polygons import box, frame, parts


def test_filters_tell_why(spark):
    df = spark.createDataFrame([(float(k % 2), 1.0 if k == 0 else 0.0, 3.0, float(k) if k < 4 else None, float(k)) for k in range(10)], "even double, rare double, same double, thin double, good double")
    got = {r.feature: (r.included, r.reason, r.n_observed) for r in S.label_free_filter(df, df.columns, 2, {"even": "locked out"}).collect()}
    assert got == {"even": (False, "locked out", 10), "rare": (False, "fewer than 2 rows on one side", 10), "same": (False, "constant", 10), "thin": (False, "observed in fewer than half of the rows", 4), "good": (True, "", 10)}
    assert {r.reason for r in S.label_free_filter(df.filter("false"), ["good"], 2).collect()} == {"observed in fewer than half of the rows"}


def test_principal_scores_equal_a_plain_decomposition(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 2))
    x = np.column_stack([base @ rng.normal(size=(2, 4)) + 0.1 * rng.normal(size=(80, 4)), np.full(80, 7.0)])
    holes = x.copy()
    holes[rng.random(x.shape) < 0.1] = np.nan
    thin = np.where(np.arange(80) < 20, 1.0 * np.arange(80), np.nan)
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r], None if np.isnan(t) else float(t)) for k, (r, t) in enumerate(zip(holes, thin, strict=True))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, same double, thin double")
    scores, explained = S.principal_scores(df, "k", ["a", "b", "c", "d", "same", "thin"], 3)
    z = (holes[:, :4] - np.nanmean(holes[:, :4], 0)) / np.nanstd(holes[:, :4], 0)
    z = np.where(np.isnan(z), 0, z)
    z = z - z.mean(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    want = u * s
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in scores.orderBy("k").collect()])
    for c in range(3):
        assert np.allclose(got[:, c], want[:, c], atol=1e-8) or np.allclose(got[:, c], -want[:, c], atol=1e-8)
    assert [r.explained for r in explained.orderBy("component").collect()] == pytest.approx((s**2 / (s**2).sum())[:3])
    none, parts_ = S.principal_scores(df, "k", ["same"], 2)
    assert none.columns == ["k"] and parts_.count() == 0


def turns(lists, most):
    taken, at = [], {n: 0 for n in lists}
    while len(taken) < most:
        before = len(taken)
        for n, items in lists.items():
            while at[n] < len(items) and items[at[n]] in [i for i, _ in taken]:
                at[n] += 1
            if at[n] < len(items) and len(taken) < most:
                taken.append((items[at[n]], n))
        if len(taken) == before:
            break
    return taken


@pytest.mark.parametrize("most", [1, 4, 30])
def test_lists_take_turns(spark, most):
    rng = random.Random(most)
    groups = {g: {n: rng.sample(range(12), rng.randrange(0, 12)) for n in ("x", "y", "z")} for g in range(12)}
    rows = [(g, n, i, k) for g, lists in groups.items() for n, items in lists.items() for k, i in enumerate(items)] + [(0, "other list", 99, 0)]
    df = spark.createDataFrame(rows, "g int, l string, i int, r int")
    got = {}
    for r in S.interleaved(df, ["g"], "l", ["x", "y", "z"], "i", [F.col("r")], most).orderBy("g", "place").collect():
        got.setdefault(r.g, []).append((r.i, r.via))
    assert got == {g: want for g, lists in groups.items() if (want := turns(lists, most))}


def test_places_come_from_the_best_source(spark):
    sites = spark.createDataFrame([(1, 10.0, 20.0, "01234", "A", "X"), (2, 0.0, 0.0, "01234-9999", "A", "X"), (3, 95.0, 1.0, "1234", "A", "X"), (4, None, None, "999999", "B", "X"), (5, None, None, None, "C", "X")], "k int, lat double, lon double, zip string, city string, state string")
    zips = spark.createDataFrame([("01234", 1.0, 2.0)], "zip5 string, lat double, lon double")
    cities = spark.createDataFrame([("A", "X", 5.0, 6.0), ("B", "X", 7.0, 8.0), ("B", "X", 9.0, 9.0)], "city string, state string, lat double, lon double")
    got = {r.k: (r.lat, r.lon, r.method) for r in S.located(sites, zips, cities).collect()}
    assert got == {1: (10.0, 20.0, "site"), 2: (1.0, 2.0, "zip"), 3: (5.0, 6.0, "city"), 4: (None, None, "not_located"), 5: (None, None, "not_located")}


def test_renames_that_collide_are_an_error(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "code string, year int")
    got = {(r.as_published, r.code, r.bridge) for r in S.bridged(df, "code", {"a": "z"}, ["code", "year"]).collect()}
    assert got == {("a", "z", "a->z"), ("b", "b", None), ("c", "c", None)}
    with pytest.raises(ValueError, match="collide.*'a'"):
        S.bridged(df, "code", {"a": "b"}, ["code", "year"])
    assert S.bridged(df, "code", {"a": "c"}, ["code", "year"]).count() == 3
    with pytest.raises(ValueError, match="one to one"):
        S.bridged(df, "code", {"a": "z", "b": "z"}, ["code"])


def test_neighbours_by_boundaries(spark):
    areas = [("a", parts([box(0, 0, 4, 4)])), ("b", parts([box(4, 1, 8, 3)])), ("c", parts([box(8.05, 0, 9, 9)])), ("d", parts([box(-1, -1, 5, 5)])), ("far", parts([box(50, 50, 51, 51)], [box(9.05, 8, 10, 9)])), ("cross", parts([box(1, -9, 2, 20)]))]
    got = {(r.a, r.b) for r in M.contiguous(frame(spark, areas), "name", 0.1).collect()}
    pairs = {("a", "b"), ("b", "c"), ("b", "d"), ("c", "far"), ("a", "cross"), ("cross", "d")}
    assert got == pairs | {(b, a) for a, b in pairs}


def test_morans_i_and_its_null_by_force(spark):
    rng = random.Random(8)
    n = 36
    edges = [(i, j) for i in range(n) for j in range(n) if abs(i // 6 - j // 6) + abs(i % 6 - j % 6) == 1] + [(0, 0), (100, 101), (101, 100)]
    values = [(k, k // 6 + rng.gauss(0, 0.3), k % 2) for k in range(n)] + [(77, 1.0, 0), (100, None, 0), (101, 3.0, 0)]
    df, links = spark.createDataFrame(values, "k int, x double, s int"), spark.createDataFrame(edges, "a int, b int")
    near = {i: [j for a, j in edges if a == i and a != j and j < n] for i in range(n)}

    def moran(x):
        m = np.mean([x[k] for k in range(n)])
        return sum((x[i] - m) * (x[j] - m) / len(near[i]) for i in range(n) for j in near[i]) / sum((x[k] - m) ** 2 for k in range(n))

    x = {k: v for k, v, _ in values[:n]}
    assert M.morans_i(df, "k", "x", links).first().t == pytest.approx(moran(x))
    kept = df.filter(f"k < {n}")
    dealt = {}
    for r in M.permuted(kept, "k", "x", 20, 5, ["s"]).collect():
        dealt.setdefault(r.draw, {})[r.k] = r.x
    assert all(sorted(d.values()) == sorted(x.values()) and all(sorted(d[k] for k in range(s, n, 2)) == sorted(x[k] for k in range(s, n, 2)) for s in (0, 1)) for d in dealt.values())
    assert len({tuple(sorted(d.items())) for d in dealt.values()}) == 20
    nulls = M.moran_null(kept, "k", "x", links, 20, 5, ["s"]).collect()
    assert {r.draw: r.t for r in nulls} == pytest.approx({d: moran(v) for d, v in dealt.items()}) and nulls[0].observed == pytest.approx(moran(x))


def test_adjusted_effect_equals_plain_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 70
    g, a, b = rng.integers(0, 2, n), rng.normal(size=n), rng.normal(size=n)
    y = 2 * g + a - b + rng.normal(size=n) * (1 + g)
    x = np.column_stack([np.ones(n), g, a, b])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    df = spark.createDataFrame([*[(float(y[i]), bool(g[i]), float(a[i]), float(b[i])) for i in range(n)], (1.0, None, 1.0, 1.0), (None, True, 1.0, 1.0)], "y double, g boolean, a double, b double")
    got = M.adjusted_effect(df, "y", F.col("g"), ["a", "b"]).first()
    assert (got.effect, got.se, got.n) == (pytest.approx(beta[1]), pytest.approx(cov[1, 1] ** 0.5), n)
    assert M.adjusted_effect(df.limit(2), "y", F.col("g"), ["a", "b"]).first().effect is None


def test_partial_spearman_and_fiscal_years(spark):
    df = spark.createDataFrame([(float(k), float(k * 7 % 11), float(k * 3 % 5)) for k in range(30)] + [(1.0, None, 2.0)], "x double, y double, z double")
    rank = lambda v: np.array([(np.array(v) < w).sum() + ((np.array(v) == w).sum() + 1) / 2 for w in v])
    x, y, z = (rank(v) for v in zip(*[(float(k), float(k * 7 % 11), float(k * 3 % 5)) for k in range(30)], strict=True))
    res = lambda v: v - np.poly1d(np.polyfit(z, v, 1))(z)
    got = M.partial_spearman(df, "x", "y", "z").first()
    assert got.rho == pytest.approx(np.corrcoef(res(x), res(y))[0, 1]) and got.n == 30
    days = spark.createDataFrame([("p", "2020-10-01"), ("p", "2021-09-30"), ("q", "2020-09-30"), ("r", None)], "p string, d string").select("p", F.to_date("d").alias("d"))
    assert {r.p: r["first"] for r in M.first_in_period(days, "p", "d", 10).collect()} == {"p": 2021, "q": 2020, "r": None}
    assert {r.p: r["first"] for r in M.first_in_period(days, "p", "d", 1).collect()} == {"p": 2020, "q": 2020, "r": None}
