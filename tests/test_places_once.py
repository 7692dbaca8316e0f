"""Rows of one place are met once, however many there are."""
import random

from pyspark.sql import functions as F

from lodestone.operators import joins, places, polygons


def met(monkeypatch, name):
    """Sizes of both sides of each call of a join of places."""
    sizes, real = [], getattr(joins, name)
    monkeypatch.setattr(joins, name, lambda a, b, *rest: sizes.append((a.count(), b.count())) or real(a, b, *rest))
    return sizes


def test_nearest_rows_of_places_that_many_share(spark, monkeypatch):
    sizes = met(monkeypatch, "radius_join")
    a = spark.range(60).select("id", (F.col("id") % 3 * 10.0).alias("alat"), F.lit(0.0).alias("alon"))
    b = spark.range(40).select((F.col("id") + 5).alias("s"), (F.col("id") % 2 * 10.0 + 0.1).alias("blat"), F.lit(0.0).alias("blon"))
    got = {r.id: r.s for r in joins.nearest_join(a, b, ("alat", "alon"), ("blat", "blon"), "s", 50.0).collect()}
    assert got == {i: 5 + i % 3 for i in range(60) if i % 3 < 2} and sizes == [(3, 2)]


def test_points_of_places_that_many_share_are_counted_in_full(spark):
    p = spark.range(90).select((F.col("id") % 3 * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("w"))
    s = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 50.0, 0.0), (4, None, 0.0)], "s long, x double, y double")
    assert {r.s: (r.n, r.population) for r in places.within(p, "w", s, "s", 1.0).collect()} == {1: (60, 120.0), 2: (60, 120.0), 3: (0, 0.0), 4: (0, 0.0)}


def test_near_is_of_a_row_and_its_place(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 0.0), (2, 0.0, 0.0), (3, None, 0.0)], "k long, x double, y double")
    near = places.near_any(p, "k", p.filter("k = 2").select("x", "y"), 1.0)
    assert near.columns == ["k", "x", "y", "near"]
    assert sorted((r.k, r.x or -1.0, r.near) for r in near.collect()) == [(1, -1.0, True), (1, 9.0, False), (2, -1.0, True), (3, -1.0, False)]


def test_points_of_one_place_are_judged_once(spark, monkeypatch):
    sizes, real = [], polygons.meeting
    monkeypatch.setattr(polygons, "meeting", lambda a, b, *rest: sizes.append(a.count()) or real(a, b, *rest))
    square = F.array(F.array(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])))
    p = spark.range(60).select("id", (F.col("id") % 3 * 3.2 + 1).alias("x"), F.lit(2.0).alias("y"))
    got = {r.id: (r.name, r.method) for r in polygons.points_in_polygons(p, "id", spark.range(1).select(F.lit(7).alias("name"), square.alias("parts")), "name", 0.5).collect()}
    assert got == {i: [(7, "inside"), (7, "snapped"), (None, "none")][i % 3] for i in range(60)}
    assert sizes == [3]


def test_items_of_pools_are_counted_once_whatever_the_groups(spark):
    rng = random.Random(3)
    pool = [(rng.choice([-70, -1, 0, 5, 63, 64, 127, 1000]), rng.randrange(12)) for _ in range(60)] + [(None, 3), (7, None)]
    items = [(rng.randrange(14), rng.choice([None, *range(9)])) for _ in range(80)] + [(99, None), (None, 1)]
    groups = spark.createDataFrame([*pool, (8, 99)], "g int, m int")
    found = joins.distinct_by_pool(groups, "g", "m", spark.createDataFrame(items, "m int, i int"), "m", "i", "n")
    met = {}
    for g, m in [*pool, (8, 99)]:
        for n, i in items:
            if g is not None and m is not None and m == n:
                met.setdefault(g, set()).update(set() if i is None else {i})
    assert {r.g: r.n for r in found.collect()} == {g: len(s) for g, s in met.items()} and 63 in met and met[8] == set()
    assert found.schema["g"].dataType.simpleString() == "int" and found.schema["n"].dataType.simpleString() == "bigint"
