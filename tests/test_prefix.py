"""Ranges and running folds against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import prefix, ranking, statistics


def _rows(n, seed=3):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", None]) if i % 3 else "a", r.choice([None, r.randint(-40, 40) * 1.0, r.random()])) for i in range(n)]


@pytest.fixture(autouse=True, params=[0, 1 << 20])
def small(request, monkeypatch):
    """All by ranges, of about half a dozen rows each; then all in one window."""
    monkeypatch.setattr(prefix, "SMALL", request.param)
    monkeypatch.setattr(prefix, "LEAST_BITS", 9)
    return request.param


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(3000), "i long, g string, v double").repartition(5)


def test_ranges_follow_the_order_and_keep_equal_keys_together(spark, table, small, monkeypatch):
    if small:
        assert prefix.with_ranges(table, ["v"]).select("_range").distinct().count() == 1
        return

    got = prefix.with_ranges(table, ["v"], 9).select("v", "_range").collect()
    got = sorted(got, key=lambda x: (x.v is not None, x.v or 0.0))
    assert [x._range for x in got] == sorted(x._range for x in got)
    assert len({x._range for x in got}) > 100 and len({(x.v, x._range) for x in got}) == len({x.v for x in got})
    assert max(sum(y._range == k for y in got if y.v is not None and y.v != int(y.v)) for k in {x._range for x in got}) < 60
    again = prefix.with_ranges(table.repartition(2), ["v"], 9).select("v", "_range").distinct()
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in got}


@pytest.mark.parametrize("fold", ["sum", "min", "max"])
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_folds(spark, table, fold, backward, by):
    kept = table.filter("v IS NOT NULL")
    got = prefix.running(prefix.with_ranges(kept, [*by, "v", "i"]), F.col("i") % 101, ["v", "i"], "r", fold, backward, by, total="t").collect()
    plain = {"sum": sum, "min": min, "max": max}[fold]
    groups = {}
    for i, g, v in _rows(3000):
        if v is not None:
            groups.setdefault(g if by else 0, []).append((v, i))
    want = {}
    for items in groups.values():
        items.sort(reverse=backward)
        values = [i % 101 for _, i in items]
        if fold == "sum":
            run = 0
            for (_, i), x in zip(items, values, strict=True):
                run += x
                want[i] = (run, sum(values))
        else:
            best = values[0]
            for (_, i), x in zip(items, values, strict=True):
                best = plain(best, x)
                want[i] = (best, plain(values))
    assert {x.i: (x.r, x.t) for x in got} == want and len(got) == len(want)


def test_ranks_by_group_on_text_and_on_nothing(spark, table):
    got = {x.i: x.p for x in ranking.percentile_rank(table.filter("g IS NOT NULL"), "v", "p", ["g"]).collect()}
    groups = {}
    for i, g, v in _rows(3000):
        if g is not None:
            groups.setdefault(g, {})[i] = v
    for items in groups.values():
        known = [v for v in items.values() if v is not None]
        for i, v in list(items.items())[:150]:
            want = None if v is None else (sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2) / len(known)
            assert got[i] == pytest.approx(want) if want is not None else got[i] is None
    words = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "w string")
    assert sorted((x.w, x.k) for x in ranking.dense_code(words, "w", "k").collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]
    empty = spark.createDataFrame([], "i long, v double")
    assert ranking.percentile_rank(empty, "v", "p").count() == 0 and statistics.bh_adjust(empty, "v", "i", "q").count() == 0


def test_adjusted_p_values(spark):
    r = random.Random(5)
    data = [(i, None if i % 7 == 0 else r.choice([r.random(), 0.01, 0.5])) for i in range(1500)]
    df = spark.createDataFrame(data, "i long, p double").repartition(4)
    known = sorted((p, i) for i, p in data if p is not None)
    n, bh, holm = len(known), {}, {}
    low = 1.0
    for at in range(n, 0, -1):
        low = min(low, known[at - 1][0] * n / at)
        bh[known[at - 1][1]] = low
    high = 0.0
    for at, (p, i) in enumerate(known, 1):
        high = max(high, p * (n - at + 1))
        holm[i] = min(1.0, high)
    for f, want in ((statistics.bh_adjust, bh), (statistics.holm_adjust, holm)):
        got = {x.i: x.q for x in f(df, "p", "i", "q").collect()}
        assert len(got) == 1500
        assert all(q is None if i not in want else q == pytest.approx(want[i]) for i, q in got.items())
