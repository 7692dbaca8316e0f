import hashlib
import random

import numpy as np
import pytest

from lodestone.operators import crossval as C

FEATURES = ["a", "b", "c"]


def table(n=150, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rng.gauss(0, 2), rng.gauss(1, 1)
        y = int(rng.random() < 1 / (1 + np.exp(-(a - b))))
        out.append((k, y, None if k % 9 == 0 else a, b if k % 4 else float(round(b)), 5.0))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, y int, a double, b double, c double")


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def dealt(rows, folds, repeats, seed):
    own = {}
    for r in range(repeats):
        for y in (0, 1):
            for i, k in enumerate(sorted((row[0] for row in rows if row[1] == y), key=lambda k: (u(seed, r, k), k))):
                own[k, r] = i % folds
    return own


def prepared(rows, train):
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
    median = np.nanmedian(x[train], axis=0)
    x = np.where(np.isnan(x), median, x)
    spread = x[train].std(0)
    return np.column_stack([np.ones(len(x)), (x - x[train].mean(0)) / np.where(spread > 1e-12, spread, 1)])


def ridge(z, y, c):
    d = np.diag([0.0] + [1 / c] * (z.shape[1] - 1))
    b = np.zeros(z.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve(z.T @ (z * (mu * (1 - mu))[:, None]) + d + 1e-12 * np.eye(len(b)), z.T @ (mu - y) + d @ b)
    return b


def lasso(z, y, c):
    """By small proximal steps."""
    step = 4 / np.linalg.norm(z, 2) ** 2
    b = np.zeros(z.shape[1])
    for _ in range(20_000):
        g = b - step * (z.T @ (1 / (1 + np.exp(-z @ b)) - y))
        b = np.sign(g) * np.maximum(0, abs(g) - step / c)
    return b


def test_folds_are_stratified_and_rows_without_a_label_stay_out(spark):
    rows = table()
    got = {r.k: list(r.folds) for r in C.stratified_folds(frame(spark, [*rows, (900, None, 1.0, 1.0, 1.0)]), "k", "y", 4, 3, 9).collect()}
    own = dealt(rows, 4, 3, 9)
    assert got == {r[0]: [own[r[0], rep] for rep in range(3)] for r in rows}


def test_out_of_fold_scores_equal_a_plain_version(spark):
    rows = table()
    scores, models = C.cross_validated(frame(spark, rows), "k", "y", FEATURES, 3, 2, 9)
    own, y = dealt(rows, 3, 2, 9), np.array([r[1] for r in rows])
    expected = {}
    for r in range(2):
        for f in range(3):
            train = np.array([own[row[0], r] != f for row in rows])
            z = prepared(rows, train)
            b = ridge(z[train], y[train], 1.0)
            assert models.beta[r * 3 + f] == pytest.approx(b, abs=1e-6)
            expected.update({(row[0], r): 1 / (1 + np.exp(-z[i] @ b)) for i, row in enumerate(rows) if not train[i]})
    got = {(s.k, s.repeat): s.score for s in scores.collect()}
    assert got == pytest.approx(expected, abs=1e-6) and len(got) == 300


def test_what_a_row_holds_never_reaches_the_model_that_scores_it(spark):
    rows = table()
    changed = [(k, y, 1e6 if k == 17 else a, b, c) for k, y, a, b, c in rows]
    one, two = (C.cross_validated(frame(spark, r), "k", "y", FEATURES, 3, 1, 9) for r in (rows, changed))
    fold = dealt(rows, 3, 1, 9)[17, 0]
    for m in range(3):
        same = all(getattr(one[1], n)[m] == pytest.approx(getattr(two[1], n)[m], abs=1e-9) for n in ("median", "mean", "spread", "beta"))
        assert same == (m == fold)


def test_the_lasso_keeps_at_most_so_many_features_and_equals_a_plain_one(spark):
    rng = random.Random(5)
    rows = [(k, int(rng.random() < 1 / (1 + np.exp(-2 * (v := rng.gauss(0, 1))))), v, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(160)]
    _, models = C.cross_validated(frame(spark, rows), "k", "y", FEATURES, 2, 1, 4, most_features=1)
    own, y = dealt(rows, 2, 1, 4), np.array([r[1] for r in rows])
    for f in range(2):
        train = np.array([own[row[0], 0] != f for row in rows])
        z = prepared(rows, train)
        assert (models.beta[f, 1:] != 0).sum() <= 1 and models.beta[f, 1] != 0
        assert models.beta[f] == pytest.approx(lasso(z[train], y[train], models.c[f]), abs=1e-5)
        if models.c[f] < 1:
            assert (abs(lasso(z[train], y[train], 2 * models.c[f])[1:]) > 1e-7).sum() > 1


def test_a_feature_without_values_counts_as_nothing(spark):
    rows = [(k, y, None, b, c) for k, y, a, b, c in table(60)]
    scores, models = C.cross_validated(frame(spark, rows), "k", "y", FEATURES, 3, 1, 9)
    assert np.allclose(models.beta[:, 1], 0) and np.allclose(models.beta[:, 3], 0) and scores.count() == 60
    with pytest.raises(ValueError, match="no labelled rows"):
        C.cross_validated(frame(spark, []), "k", "y", FEATURES, 3, 1, 9)


def near_twins(n=240):
    """Two features that are nearly the same, a label that turns on their difference, and one of noise."""
    rng = random.Random(7)
    out = []
    for k in range(n):
        a, d = rng.gauss(0, 1), rng.gauss(0, 0.05)
        out.append((k, int(rng.random() < 1 / (1 + np.exp(-60 * d))), a, a + d, rng.gauss(0, 1)))
    return out


def test_near_twins_are_solved_exactly_in_few_sweeps():
    rng = np.random.default_rng(1)
    a = rng.normal(size=20_000)
    z = np.column_stack([np.ones(len(a)), a, a + 0.01 * rng.normal(size=len(a)), rng.normal(size=len(a))])
    gram, penalty = z.T @ z / 4, np.full(4, 0.3)
    gradient = -gram @ np.array([0.1, -8.0, 9.0, 0.0])
    b = C.descend(gram, gradient, np.zeros(4), penalty, sweeps=30)
    slope = gradient + gram @ b
    on = b != 0
    assert on[1] and on[2] and abs(slope + penalty * np.sign(b))[on].max() < 1e-6 and (abs(slope[~on]) <= penalty[~on] + 1e-6).all()


def test_all_strengths_share_few_passes_and_each_model_takes_the_largest_that_will_do(spark, monkeypatch):
    rows, passes, real = near_twins(), [], C._derivatives
    monkeypatch.setattr(C, "_derivatives", lambda *a: passes.append(1) or real(*a))
    _, models = C.cross_validated(frame(spark, rows), "k", "y", FEATURES, 2, 1, 4, c=8.0, most_features=1)
    assert len(passes) <= 20
    own, y = dealt(rows, 2, 1, 4), np.array([r[1] for r in rows])
    for f in range(2):
        train = np.array([own[row[0], 0] != f for row in rows])
        z = prepared(rows, train)
        assert models.beta[f] == pytest.approx(lasso(z[train], y[train], models.c[f]), abs=1e-5) and (models.beta[f, 1:] != 0).sum() <= 1
        assert (abs(lasso(z[train], y[train], 2 * models.c[f])[1:]) > 1e-7).sum() > 1


def test_the_ladder_goes_on_until_few_features_are_left(spark):
    _, models = C.cross_validated(frame(spark, near_twins()), "k", "y", FEATURES, 2, 1, 4, c=2.0**14, most_features=0)
    assert (models.beta[:, 1:] == 0).all() and (models.c < 1).all()
