import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import beta
from lodestone.operators import intervals as I


def test_quantiles_equal_the_known_ones():
    assert beta.beta_quantile(0.025, 5.5, 5.5) == pytest.approx(0.2235287, abs=1e-6)
    assert beta.beta_quantile([0.025, 0.975], [5, 6], [6, 5]) == pytest.approx([0.1870860, 0.8129140], abs=1e-6)
    assert beta.beta_quantile(0.5, 1, 1) == pytest.approx(0.5) and beta.beta_quantile(0.3, 1, 3) == pytest.approx(1 - 0.7 ** (1 / 3))
    assert beta.student_quantile(0.975, [1, 10, 1e6]) == pytest.approx([12.706205, 2.228139, 1.959966], abs=1e-4)
    assert np.isnan(beta.beta_quantile(0.5, [0, -1, np.nan], 1.0)).all()
    x = np.linspace(0.01, 0.99, 25)
    assert beta.cumulative(beta.beta_quantile(x, 0.5, 40.0), 0.5, 40.0) == pytest.approx(x, abs=1e-9)


def test_jeffreys(spark):
    df = spark.createDataFrame([(5, 10), (0, 10), (10, 10), (3, 0), (None, 4), (5, 4)], "k int, n int")
    got = {(r.k, r.n): (r.low, r.high) for r in I.jeffreys(df, "k", "n").collect()}
    assert got[5, 10] == (pytest.approx(0.2235287, abs=1e-6), pytest.approx(0.7764713, abs=1e-6)) and got[0, 10][0] == 0 and got[10, 10][1] == 1
    assert got[0, 10][1] == pytest.approx(1 - got[10, 10][0]) and all(got[k] == (None, None) for k in ((3, 0), (None, 4), (5, 4)))


def test_korn_graubard(spark):
    rows = [("simple", 0.5, (0.25 / 10) ** 0.5, 10, 9), ("wide", 0.3, 0.1, 200, 20), ("zero", 0.0, 0.0, 50, 20), ("one", 1.0, 0.0, 50, 20), ("few", 0.2, 0.01, 20, 3), ("good", 0.4, 0.02, 900, 30), ("little df", 0.4, 0.02, 900, 5), ("rare", 0.02, 0.012, 900, 30), ("none", None, 0.1, 10, 3), ("nan", float("nan"), 0.1, 10, 3)]
    got = {r.name: r for r in I.korn_graubard(spark.createDataFrame(rows, "name string, p double, se double, n int, df int"), "p", "se", "n", "df").collect()}
    # where the design's degrees of freedom are those of the rows it is the exact binomial interval
    assert (got["simple"].kg_low, got["simple"].kg_high, got["simple"].n_eff) == (pytest.approx(0.187086, abs=1e-5), pytest.approx(0.812914, abs=1e-5), pytest.approx(10))
    assert got["wide"].n_eff == pytest.approx(21) and got["zero"].kg_low == 0 and got["one"].kg_high == 1 and got["zero"].kg_high == pytest.approx(1 - got["one"].kg_low)
    assert {k: r.reliability.split(":")[0] for k, r in got.items()} == {"simple": "suppress", "wide": "suppress", "zero": "review", "one": "review", "few": "suppress", "good": "reliable", "little df": "review", "rare": "suppress" if got["rare"].kg_high - got["rare"].kg_low > 0.05 else "reliable", "none": "suppress", "nan": "suppress"}
    assert got["none"].n_eff is None and got["none"].kg_low is None and got["few"].n_eff == 20


def test_clustered_wilson(spark):
    rows = [("one", True, "A")] * 10 + [("spread", True, f"r{k}") for k in range(10)] + [("mixed", k < 3, "A" if k < 4 else f"r{k}") for k in range(8)] + [("mixed", None, "x"), ("mixed", True, None)]
    got = {r.g: r for r in I.clustered_wilson(spark.createDataFrame(rows, "g string, hit boolean, c string"), ["g"], F.col("hit"), "c").collect()}
    assert (got["one"].n_clusters, got["one"].n_eff, got["spread"].n_eff) == (1, 1.0, 10.0) and got["one"].low < got["spread"].low
    z = 1.959963984540054
    assert got["spread"].low == pytest.approx(10 / (10 + z * z)) and got["mixed"].n == 8 and got["mixed"].n_eff == pytest.approx(64 / 20)


def test_rounded_shares(spark):
    row = spark.createDataFrame([(50.0, 100.0, 0.0)], "p double, n double, z double").select(I.rounded_share_sd(F.col("p"), F.col("n")).alias("a"), I.rounded_share_sd(F.col("z"), F.col("n")).alias("b"), I.rounded_share_sd(F.col("p"), F.col("z")).alias("c")).first()
    assert row.a == pytest.approx((25 + 1 / 12) ** 0.5) and row.b == pytest.approx((1 / 12) ** 0.5) and row.c is None
