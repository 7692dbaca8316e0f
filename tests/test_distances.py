import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import distances as D


def brute(points, band, longest, distance):
    pairs, sums = Counter(), Counter()
    for i, p in enumerate(points):
        for j, q in enumerate(points):
            if i != j:
                k = min(int(distance(p, q) // band), int(longest // band))
                pairs[k] += 1
                sums[k] += p[3] * q[3]
    return {k: (n, pytest.approx(sums[k], abs=1e-6)) for k, n in pairs.items()}


def plane(p, q):
    return math.dist(p[:3], q[:3])


@pytest.mark.parametrize(("leaf", "levels"), [(1024, 16), (1, 16), (1, 3)])
def test_pair_sums_by_force(spark, monkeypatch, leaf, levels):
    monkeypatch.setattr(D, "LEAF", leaf)
    monkeypatch.setattr(D, "LEVELS", levels)
    rng = random.Random(6)
    points = [(rng.uniform(0, 30), rng.gauss(0, 3), 0.0, rng.gauss(0, 1)) for _ in range(150)]
    points += [(5.0, 1.0, 0.0, rng.gauss(0, 1)) for _ in range(40)]  # one place that many share
    df = spark.createDataFrame([*points, (None, 1.0, 0.0, 1.0), (1.0, 1.0, 0.0, None)], "x double, y double, z double, v double")
    got = {r["class"]: (r.pairs, r.s_v) for r in D.pair_sums(df, ["v"], 4.0, 14.0, False).collect()}
    assert got == brute(points, 4.0, 14.0, plane)


@pytest.mark.parametrize(("leaf", "band"), [(16, 4.0), (256, 25.0)])
def test_pair_sums_over_blocks_write_no_pairs(spark, monkeypatch, leaf, band):
    for name, value in (("LEAF", leaf), ("BLOCK", 64), ("FEW", 16), ("RUN", 4)):
        monkeypatch.setattr(D, name, value)
    written, save = [], D.saved
    monkeypatch.setattr(D, "saved", lambda df, name: written.append(save(df, name)) or written[-1])
    rng = random.Random(7)
    points = [(float(rng.randrange(40)), float(rng.randrange(30)), 0.0, rng.gauss(0, 1)) for _ in range(400)]  # whole numbers: many distances are borders
    got = {r["class"]: (r.pairs, r.s_v) for r in D.pair_sums(spark.createDataFrame(points, "x double, y double, z double, v double"), ["v"], band, 40.0, False).collect()}
    assert got == brute(points, band, 40.0, plane)
    assert sum(w.count() for w in written) <= 2 * len(points)


def test_pair_sums_of_one_place_and_of_nothing(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 2.0)] * 3, "x double, y double, z double, v double")
    assert [tuple(r) for r in D.pair_sums(one, ["v"], 1.0, 5.0, False).collect()] == [(0, 6, 24.0)]
    assert D.pair_sums(one.limit(1), ["v"], 1.0, 5.0, False).collect() == []
    assert D.pair_sums(one.filter("false"), ["v"], 1.0, 5.0, False).collect() == []


def haversine(a, b):
    (la, lo), (ma, mo) = ([math.radians(v) for v in p] for p in (a, b))
    return 2 * D.EARTH_KM * math.asin(math.sqrt(math.sin((ma - la) / 2) ** 2 + math.cos(la) * math.cos(ma) * math.sin((mo - lo) / 2) ** 2))


def test_effective_size_by_force(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(120):
        lat, lon = rng.uniform(30, 45), rng.uniform(-110, -80)
        rows.append((lat, lon, lat + rng.gauss(0, 1), lat + 0.1 * lon + rng.gauss(0, 3)))
    rank = lambda v: [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]
    centred = lambda v: [x - sum(v) / len(v) for x in v]
    u, v = (centred(rank([r[k] for r in rows])) for k in (2, 3))
    n = len(rows)
    pairs, su, sv = Counter(), Counter(), Counter()
    for i in range(n):
        for j in range(n):
            if i != j:
                k = min(int(haversine(rows[i][:2], rows[j][:2]) // 100), 20)
                pairs[k], su[k], sv[k] = pairs[k] + 1, su[k] + u[i] * u[j], sv[k] + v[i] * v[j]
    uu, vv, uv = (sum(a * b for a, b in zip(x, y, strict=True)) for x, y in ((u, u), (v, v), (u, v)))
    variance = (n + sum(su[k] * sv[k] / pairs[k] for k in pairs) / (uu / n) / (vv / n)) / n**2
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "lat double, lon double, a double, b double")
    got = D.effective_n(df, "a", "b", "lat", "lon").first()
    size = min(max(1 + 1 / variance, 3), n)
    assert (got.n, got.rho, got.n_eff) == (n, pytest.approx(uv / math.sqrt(uu * vv)), pytest.approx(size)) and size < n / 2
    plain = D.student_p(abs(got.rho) * math.sqrt((n - 2) / (1 - got.rho**2)), n - 2)
    assert plain < got.p < 1
    assert D.effective_n(df.limit(3), "a", "b", "lat", "lon").first().n_eff is None
    assert D.effective_n(df.withColumn("a", F.lit(1.0)), "a", "b", "lat", "lon").first().rho is None


def test_student_tails_equal_the_known_ones():
    for t, df, p in ((0.0, 5, 1.0), (2.570582, 5, 0.05), (1.959964, 1e7, 0.05), (12.706205, 1, 0.05), (4.032143, 5, 0.01), (0.1, 3.5, 0.925)):
        assert D.student_p(t, df) == pytest.approx(p, abs=2e-3 if df == 3.5 else 1e-6)
