import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import polygons as P

PARTS = "parts array<array<array<struct<x: double, y: double>>>>"


def parts(*rings_of_parts):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in rings_of_parts]


def frame(spark, rows, name="name"):
    return spark.createDataFrame(rows, f"{name} string, {PARTS}")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def cut(subject, clip):
    """What a convex polygon (against the clock) leaves of another convex one: cut by each edge's half-plane in turn."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        new = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            if side(p) >= 0:
                new.append(p)
            if (side(p) > 0 > side(q)) or (side(p) < 0 < side(q)):
                t = side(p) / (side(p) - side(q))
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = new
        if not out:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1], strict=True))) / 2


def hull(points):
    points = sorted(points)

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def test_overlaps_equal_a_clip_of_convex_polygons_of_very_different_sizes(spark):
    rng = random.Random(3)

    def convex(k):
        x, y, size = rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-1, 2)
        return f"p{k}", hull([(x + rng.uniform(-size, size), y + rng.uniform(-size, size)) for _ in range(rng.randrange(4, 40))])

    a, b = [convex(k) for k in range(40)], [convex(k) for k in range(40)]
    turned = lambda k, ring: ring[::-1] if k % 2 else [*ring, ring[0]]
    found = P.overlaps(frame(spark, [(n, parts([turned(k, r)])) for k, (n, r) in enumerate(a)], "a_name"), "a_name", frame(spark, [(n, parts([r])) for n, r in b], "b_name"), "b_name")
    rows = found.collect()
    got = {(r.a_name, r.b_name): (r.area, r.share_a, r.share_b) for r in rows}
    assert len(got) == len(rows)
    expected = {(n, m): cut(r, s) for n, r in a for m, s in b}
    sure = {k for k, v in expected.items() if v > 1e-6}
    assert sure <= set(got) and all(expected[k] > 1e-9 for k in got) and len(sure) > 100
    areas = {n: cut(r, r) for n, r in a}
    for k in sure:
        assert got[k][0] == pytest.approx(expected[k], rel=1e-7, abs=1e-9) and got[k][1] == pytest.approx(expected[k] / areas[k[0]], rel=1e-6, abs=1e-9)


def test_overlaps_of_parts_and_holes(spark):
    ring = parts([box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(20, 0, 22, 2)])  # 64 + 4
    turned = parts([box(0, 0, 10, 10)[::-1], box(2, 2, 8, 8)], [box(20, 0, 22, 2)[::-1]])
    others = [("hole", parts([box(3, 3, 7, 7)])), ("across", parts([box(-5, 4, 30, 6)])), ("far part", parts([box(21, 1, 30, 30)])), ("beside", parts([box(10, 0, 12, 10)])), ("all", parts([box(-1, -1, 40, 40)])), ("itself", turned)]
    for form in (ring, turned):
        got = {r.other: (r.area, r.share_a, r.share_b) for r in P.overlaps(frame(spark, [("ring", form)]), "name", frame(spark, others, "other"), "other").collect()}
        assert set(got) == {"across", "far part", "all", "itself"}
        assert got["across"][0] == pytest.approx(8) and got["far part"][0] == pytest.approx(1) and got["all"][:2] == (pytest.approx(68), pytest.approx(1)) and got["itself"] == (pytest.approx(68), pytest.approx(1), pytest.approx(1))
    kept = P.overlaps(frame(spark, [("ring", ring)]), "name", frame(spark, others, "other"), "other", least_share=0.1)
    assert {r.other for r in kept.collect()} == {"across", "all", "itself"}


def test_overlaps_of_a_ragged_polygon_with_many_corners(spark):
    rng = random.Random(8)
    xs = [k / 50 for k in range(1501)]
    low, high = [rng.uniform(0, 4) for _ in xs], [rng.uniform(6, 9) for _ in xs]
    ragged = list(zip(xs, low, strict=True)) + list(zip(xs, high, strict=True))[::-1]
    window = box(3, 5, 20, 7.5)
    # by columns: the upper border is cut at 7.5, the lower one lies below the window
    whole = sum((b - a) * integral for a, b, integral in ((x, y, mean_below(p, q, 7.5) - 5) for x, y, p, q in zip(xs, xs[1:], high, high[1:], strict=False) if 3 <= x and y <= 20 + 1e-12))
    got = P.overlaps(frame(spark, [("r", parts([ragged]))]), "name", frame(spark, [("w", parts([window]))], "other"), "other").first()
    assert got.area == pytest.approx(whole, rel=1e-9)


def mean_below(p, q, top):
    """Mean of the smaller of `top` and a line from p to q."""
    if max(p, q) <= top:
        return (p + q) / 2
    if min(p, q) >= top:
        return top
    low, high = sorted((p, q))
    t = (top - low) / (high - low)
    return t * (low + top) / 2 + (1 - t) * top


def test_nulls_and_empty_polygons_overlap_with_nothing(spark):
    odd = frame(spark, [("null", None), ("empty", []), ("no rings", [[]]), ("two corners", parts([[(0, 0), (1, 1)]])), ("line", parts([[(0, 0), (1, 1), (2, 2)]]))])
    square = frame(spark, [("s", parts([box(0, 0, 4, 4)]))], "other")
    assert P.overlaps(odd, "name", square, "other").collect() == [] and P.overlaps(square, "other", odd, "name").collect() == []
    assert P.overlaps(odd.filter("false"), "name", square, "other").collect() == []


def test_points_are_inside_snapped_to_the_boundary_or_nowhere(spark):
    polygons = frame(spark, [("plate", parts([box(0, 0, 10, 4), box(4, 1, 6, 3)])), ("b", parts([box(30, 0, 34, 4)], [box(40, 0, 44, 4)])), ("c", parts([box(30, 0, 34, 4)]))])
    points = [(1, 2.0, 2.0), (2, 5.0, 4.1), (3, 5.0, 2.0), (4, 5.0, 1.2), (5, 20.0, 2.0), (6, None, 1.0), (7, 31.0, 1.0), (8, 41.0, 1.0), (9, 44.7, 4.7), (10, 44.8, 4.8), (11, -1.0, 4.0)]
    found = P.points_in_polygons(spark.createDataFrame(points, "k int, x double, y double"), "k", polygons, "name", 1.0)
    got = {r.k: (r.name, r.method) for r in found.collect()}
    inside, snapped, none = "inside", "snapped", (None, "none")
    assert got == {1: ("plate", inside), 2: ("plate", snapped), 3: ("plate", snapped), 4: ("plate", snapped), 5: none, 6: none, 7: ("b", inside), 8: ("b", inside), 9: ("b", snapped), 10: none, 11: ("plate", snapped)}
    assert {r.method for r in P.points_in_polygons(spark.createDataFrame(points, "k int, x double, y double"), "k", polygons.filter("false"), "name", 1.0).collect()} == {"none"}


def test_a_box_lies_in_few_cells_whatever_its_size(spark):
    boxes = P.boxed(frame(spark, [(str(k), parts([box(-(2.0**k), 1, 2.0**k, 1 + 2.0 ** (k - 3))])) for k in range(-20, 30, 7)]), "name")
    own = P._in_cells(boxes, P.levels(boxes)).filter("_own").groupBy("name").agg(F.count("*").alias("n"))
    assert max(r.n for r in own.collect()) <= 4
