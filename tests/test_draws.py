import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import concordance, draws


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def table(seed=1, n=400):
    rng = random.Random(seed)
    return [(k, rng.gauss(0, 1) + 3 * (k % 3), rng.random() < 0.3, "abc"[k % 3]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v double, c boolean, s string")


@pytest.mark.parametrize("strata", [[], ["s"]])
@pytest.mark.parametrize("at_border", [4096, 8])
def test_every_draw_deals_exactly_as_many_cases(spark, monkeypatch, strata, at_border):
    monkeypatch.setattr(draws, "AT_BORDER", at_border)  # 8: many classes, so that the border is ranked in small ones
    rows = table()
    expected = {}
    for d in range(15):
        cases = set()
        for s in ["a", "b", "c"] if strata else [None]:
            own = [r for r in rows if s in (None, r[3])]
            cases |= {r[0] for r in sorted(own, key=lambda r: (u(7, d, r[0]), r[0]))[: sum(r[2] for r in own)]}
        expected[d] = np.mean([r[1] for r in rows if r[0] in cases]) - np.mean([r[1] for r in rows if r[0] not in cases])
    odd = [(9001, None, True, "a"), (9002, 1.0, None, "a")]
    got = {r.draw: (r.t, r.observed) for r in draws.permuted_gaps(frame(spark, rows + odd), "v", F.col("c"), "k", 15, 7, strata).collect()}
    observed = np.mean([r[1] for r in rows if r[2]]) - np.mean([r[1] for r in rows if not r[2]])
    assert {d: t for d, (t, _) in got.items()} == pytest.approx(expected) and got[0][1] == pytest.approx(observed)


def test_a_shift_is_found_and_two_centres_differ_where_strata_carry_it(spark):
    rng = random.Random(5)
    rows = [(k, (4.0 if k % 2 else 0.0) + rng.gauss(0, 1), rng.random() < (0.8 if k % 2 else 0.2), "ab"[k % 2]) for k in range(300)]
    free = draws.permutation_null(frame(spark, rows), "v", F.col("c"), "k", 99, 3).first()
    within = draws.permutation_null(frame(spark, rows), "v", F.col("c"), "k", 99, 3, ["s"]).first()
    assert free.p == pytest.approx(0.01) and abs(free.null_mean) < 0.3
    assert within.p > 0.5 and within.null_mean > 1 and within.retained > 0.8  # the strata alone make the gap
    assert free.draws == within.draws == 99


def test_a_null_without_cases_or_rows(spark):
    none = draws.permutation_null(frame(spark, [(1, 1.0, False, "a"), (2, 2.0, False, "a")]), "v", F.col("c"), "k", 5, 1)
    assert none.count() <= 1 and all(r.observed is None for r in none.collect())
    assert all(r.t is None for r in draws.permuted_gaps(frame(spark, []), "v", F.col("c"), "k", 5, 1).collect())


def test_cluster_weights_add_up_in_every_stratum_and_draw(spark):
    clusters = spark.createDataFrame([(s, c) for s in "ab" for c in range(7 if s == "a" else 1)], "s string, c int")
    got = draws.cluster_weights(clusters, "c", 30, 4, ["s"]).groupBy("s", "draw").agg(F.sum("weight").alias("n")).collect()
    assert {(r.s, r.n) for r in got} == {("a", 7), ("b", 1)} and len(got) == 60


def test_bootstraps_equal_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randrange(6)), rng.random() < 0.5, "abcdefgh"[rng.randrange(8)]) for k in range(120)] + [(999, None, True, "a"), (998, 1.0, True, None)]
    df = frame(spark, rows).withColumn("w", (F.col("k") * 17 % 11).cast("double"))
    names = sorted({r[3] for r in rows if r[3]})
    own = {c: [r for r in rows if r[3] == c and r[1] is not None] for c in names}
    picks = {d: [names[u(6, d, j) % len(names)] for j in range(len(names))] for d in range(20)}
    means = {r.draw: r.t for r in draws.bootstrap_means(df, "v", "s", 20, 6).collect()}
    assert means == pytest.approx({d: np.mean([r[1] for c in p for r in own[c]]) for d, p in picks.items()})

    def ranks(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    rho = {r.draw: r.t for r in draws.bootstrap_spearman(df, "v", "w", "s", 20, 6).collect()}
    drawn = {d: [r for c in p for r in own[c]] for d, p in picks.items()}
    assert rho == pytest.approx({d: np.corrcoef(ranks([r[1] for r in rs]), ranks([r[0] * 17 % 11 for r in rs]))[0, 1] for d, rs in drawn.items()})


def test_falling_pairs_by_force():
    rng = np.random.default_rng(0)
    for n, top in ((1, 3), (2, 1), (40, 4), (40, 1000), (65, 2)):
        for _ in range(20):
            x, y, w = rng.integers(0, top, n), rng.integers(0, top, n) / 2, rng.integers(1, 5, n)
            assert concordance.falling(x, y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
    many = np.full(3, 2**32)
    assert concordance.falling(np.array([1, 2, 3]), np.array([3, 2, 1]), many) == 3 * 2**64


@pytest.mark.parametrize("kind", ["ties", "hot x", "hot y", "none"])
def test_tau_b_by_force(spark, kind):
    rng = random.Random(4)
    value = {"ties": lambda k: (k % 7, rng.randrange(5)), "hot x": lambda k: (0 if k % 3 else k, rng.randrange(300)), "hot y": lambda k: (rng.random(), 1 if k % 3 else -k), "none": lambda k: (rng.random(), rng.random())}[kind]
    rows = [tuple(map(float, value(k))) for k in range(500)]
    sign = lambda a: (a > 0) - (a < 0)
    signs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    s, tx, ty = sum(a * b for a, b in signs), sum(a == 0 for a, _ in signs), sum(b == 0 for _, b in signs)
    got = concordance.kendall_tau_b(spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "a double, b double"), "a", "b").first()
    assert got.n == 500 and int(got.discordant) == sum(a * b < 0 for a, b in signs) and int(got.concordant) == sum(a * b > 0 for a, b in signs) and (int(got.ties_x), int(got.ties_y)) == (tx, ty)
    assert got.tau_b == pytest.approx(s / ((len(signs) - tx) * (len(signs) - ty)) ** 0.5)


def test_tau_b_of_constant_and_empty_columns_is_null(spark):
    assert concordance.kendall_tau_b(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first().tau_b is None
    none = concordance.kendall_tau_b(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert none.tau_b is None and none.n == 0
