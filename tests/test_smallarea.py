import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import smallarea as S


def test_cells_are_raked_to_margins_that_agree(spark):
    rng = random.Random(1)
    true = {(a, s, e): rng.randrange(1, 90) * (0 if (a, s) == (2, "f") else 1) for a in range(4) for s in "mf" for e in "xyz"}
    total = lambda keep: [(*k, float(sum(v for c, v in true.items() if tuple(c[i] for i in keep) == k))) for k in sorted({tuple(c[i] for i in keep) for c in true})]
    margins = [(["a", "s"], spark.createDataFrame(total([0, 1]), "a int, s string, n double"), "n"), (["a", "e"], spark.createDataFrame(total([0, 2]), "a int, e string, t double"), "t")]
    seed = spark.createDataFrame([(*c, 0.2 + rng.random(), "kept") for c in true], "a int, s string, e string, w double, note string")
    got = S.raked_until(seed, "w", margins, within=["a"])
    assert got.columns == seed.columns and max(r.off for r in S.off_margins(got, "w", margins).collect()) <= 1e-9
    assert all(r.w == 0 for r in got.filter("a = 2 AND s = 'f'").collect())
    # odds ratios stay those of the seed
    before, after = ({(r.a, r.s, r.e): r.w for r in df.collect()} for df in (seed, got))
    odds = lambda w, a: w[a, "m", "x"] * w[a, "f", "y"] / (w[a, "m", "y"] * w[a, "f", "x"])
    assert odds(after, 1) == pytest.approx(odds(before, 1))
    with pytest.raises(ValueError, match="margins aren't met"):
        S.raked_until(seed, "w", [margins[0], (["a", "e"], margins[1][1].withColumn("t", F.col("t") + 1), "t")], most=8, within=["a"])


def test_shares_fall_back_to_all_groups(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 0), ("b", "y", 0)], "g string, e string, n int")
    assert {(r.g, r.e): r.s for r in S.shares(counts, ["g"], ["e"], "n", "s").collect()} == {("a", "x"): 0.75, ("a", "y"): 0.25, ("b", "x"): 0.75, ("b", "y"): 0.25}
    assert {r.s for r in S.shares(counts.filter("g = 'b'"), ["g"], ["e"], "n", "s").collect()} == {0.0}


def cells(seed=2, groups=12):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        u = rng.normal(0, 0.6)
        for x in (0.0, 1.0, 2.5):
            n = int(rng.integers(5, 60))
            out.append((f"g{g}", 1.0, x, float(rng.binomial(n, 1 / (1 + math.exp(-(-1 + 0.5 * x + u))))), float(n)))
    return out


def plain(rows, s2):
    """Coefficients, intercepts and the marginal log-likelihood by Newton's method on all parameters at once."""
    names = sorted({r[0] for r in rows})
    x = np.array([[r[1], r[2]] for r in rows])
    z = np.array([[float(r[0] == g) for g in names] for r in rows])
    y, n, a = np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.hstack([x, z])
    penalty = np.diag([0.0, 0.0] + [1 / s2] * len(names))
    th = np.zeros(a.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-a @ th))
        th = th + np.linalg.solve(a.T @ (a * (n * mu * (1 - mu))[:, None]) + penalty, a.T @ (y - n * mu) - penalty @ th)
    mu = 1 / (1 + np.exp(-a @ th))
    v = n * mu * (1 - mu)
    f = (n * np.logaddexp(0, a @ th) - y * (a @ th)).sum() + th @ penalty @ th / 2
    ll = -(f + len(names) * math.log(s2) / 2 + 0.5 * np.log(z.T @ v + 1 / s2).sum())
    cov = np.linalg.inv(a.T @ (a * v[:, None]) + penalty)
    return th[:2], dict(zip(names, th[2:], strict=True)), ll, cov


COLUMNS = "g string, one double, x double, y double, n double"


def test_the_model_equals_a_plain_fit(spark):
    rows = cells()
    df = spark.createDataFrame([*rows, ("g0", 1.0, None, 3.0, 9.0), (None, 1.0, 1.0, 1.0, 2.0), ("g1", 1.0, 0.0, 0.0, 0.0)], COLUMNS)
    fit = S.random_intercepts(df, ["one", "x"], "y", "n", "g", 0.3)
    beta, u, ll, cov = plain(rows, 0.3)
    assert fit.converged and fit.beta == pytest.approx(beta, abs=1e-6) and fit.log_likelihood == pytest.approx(ll, abs=1e-6)
    assert {r.g: r.u for r in fit.groups.collect()} == pytest.approx(u, abs=1e-6)
    assert fit.cov == pytest.approx(cov[:2, :2], abs=1e-8)
    with pytest.raises(ValueError, match="hits and misses"):
        S.random_intercepts(df.withColumn("y", F.lit(0.0)), ["one"], "y", "n", "g", 0.3)


def test_the_variance_makes_the_marginal_likelihood_largest(spark):
    rows = cells(groups=6)
    fit = S.random_intercepts(spark.createDataFrame(rows, COLUMNS), ["one", "x"], "y", "n", "g", exact=0.5)
    best = max((plain(rows, s2)[2], s2) for s2 in np.exp(np.linspace(math.log(1e-5), math.log(4), 120)))
    assert abs(math.log(fit.sigma2 / best[1])) < 0.5 and fit.log_likelihood <= best[0] + 1e-3


def test_draws_scatter_as_the_model_says_and_absent_groups_have_their_own(spark):
    rows = cells()
    df = spark.createDataFrame(rows, COLUMNS)
    fit = S.random_intercepts(df, ["one", "x"], "y", "n", "g", 0.3)
    people = spark.createDataFrame([("p", "g0", 1.0, 0.0, 10.0), ("p", "g0", 1.0, 1.0, 30.0), ("q", "new", 1.0, 0.0, 5.0), ("empty", "g1", 1.0, 0.0, 0.0)], "area string, g string, one double, x double, people double")
    drawn = S.area_draws(fit, people, "area", "g", "people", 400, 8)
    got = {r.area: r for r in S.summarised(drawn, ["area"]).collect()}
    beta, u, _, cov = plain(rows, 0.3)
    expit = lambda t: 1 / (1 + math.exp(-t))
    centre = 0.25 * expit(beta[0] + u["g0"]) + 0.75 * expit(beta.sum() + u["g0"])
    assert got["p"].mean == pytest.approx(centre, abs=0.02) and got["p"].low < centre < got["p"].high and got["p"].people == 40
    # the linear predictor of an area of one cell: its variance is that of beta_0 and of the intercept
    etas = [math.log(r.rate / (1 - r.rate)) for r in drawn.filter("area = 'q'").collect()]
    assert np.std(etas) == pytest.approx(math.sqrt(cov[0, 0] + 0.3), rel=0.15)
    assert got["empty"].mean is None
    whole = S.summarised(drawn.withColumn("all", F.lit(1)), ["all"]).first()
    assert whole.people == 45 and got["p"].low < whole.mean < max(got["p"].high, got["q"].high)
