"""Polygons of several parts with holes: overlap areas, points within, the nearest boundary.

A polygon is a column `parts`: an array of parts, a part an array of rings (the first its border, the others holes), a ring an array of
(x, y) structs, closed or not, in either direction.  Null or empty parts and rings of fewer than three corners have no area.

Boxes meet on a grid of several levels: a box lies in at most four cells of the level at which a cell is as long as its longer side, whatever
its size, and meets smaller boxes there that are lifted to that level.  So joins are on equal cells, nothing covers an unbounded number of them,
and the cell that holds the lower left corner of two boxes' overlap gives each pair once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The finest level's cells are 2 ** FINEST long; smaller boxes and points take it.
FINEST = -40
#: Edges of two polygons meet by strips of the x-axis, at most this many for a pair.
STRIPS = 256
#: Tasks among which the places of points are dealt.
TASKS = 192


def polygon(ring: Column) -> Column:
    """One ring as parts."""
    return F.array(F.array(ring))


def _ring_edges(ring: Column, hole: Column) -> Column:
    """Edges of a ring with `turn`: 1 if its inside lies to the left, -1 to the right; the other way round for a hole."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    plain = F.zip_with(ring, after, lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
    twice = F.aggregate(plain, F.lit(0.0), lambda s, e: s + (e["bx"] - e["ax"]) * (e["by"] + e["ay"]))  # positive: clockwise
    turn = -F.signum(twice) * F.when(hole, -1.0).otherwise(1.0)
    return F.when(F.size(ring) >= 3, F.transform(plain, lambda e: e.withField("turn", turn))).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double,turn:double>>"))


def edges(parts: Column) -> Column:
    """All edges of a polygon as (ax, ay, bx, by, turn)."""
    rings = F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<array<array<struct<x:double,y:double>>>>")), lambda part: F.transform(part, lambda ring, i: F.struct(ring.alias("ring"), (i > 0).alias("hole")))))
    return F.flatten(F.transform(rings, lambda r: _ring_edges(r["ring"], r["hole"])))


def area(edge_list: Column) -> Column:
    return F.aggregate(edge_list, F.lit(0.0), lambda s, e: s - e["turn"] * (e["bx"] - e["ax"]) * (e["by"] + e["ay"]) / 2)


def holds(edge_list: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the crossings to its right; a hole's inside is outside."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(edge_list, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def distance(edge_list: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the boundary: from the nearest point of the nearest edge."""

    def away(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return F.sqrt(F.pow(e["ax"] + along * dx - x, F.lit(2)) + F.pow(e["ay"] + along * dy - y, F.lit(2)))

    return F.array_min(F.transform(edge_list, away))


def boxed(polygons: DataFrame, name: str, margin: float = 0.0) -> DataFrame:
    """polygons (name, parts) -> name, edges, x0, x1, y0, y1 (widened by margin), level; polygons without edges are left out."""
    e = polygons.select(name, edges(F.col("parts")).alias("edges")).filter(F.size("edges") > 0)
    side = lambda c, f: f(F.transform("edges", lambda x: x[c]))
    e = e.select(
        name, "edges", (side("ax", F.array_min) - margin).alias("x0"), (side("ax", F.array_max) + margin).alias("x1"), (side("ay", F.array_min) - margin).alias("y0"), (side("ay", F.array_max) + margin).alias("y1")
    )
    long = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(2.0**FINEST))
    return e.withColumn("level", F.ceil(F.log2(long)).cast("int"))


def levels(boxes: DataFrame) -> list[int]:
    """The levels that occur: at most as many as a double has exponents."""
    return sorted(r[0] for r in boxes.select("level").distinct().collect())


def _in_cells(boxes: DataFrame, others: list[int]) -> DataFrame:
    """A row for each cell that a box touches, at its own level (own) and at the larger ones of `others`."""
    at = F.array(F.struct(F.col("level").alias("l"), F.lit(True).alias("own")))
    if others:
        at = F.concat(at, F.filter(F.array(*[F.struct(F.lit(k).alias("l"), F.lit(False).alias("own")) for k in others]), lambda s: s["l"] > F.col("level")))
    size = F.pow(F.lit(2.0), F.col("_at.l"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    out = boxes.withColumn("_at", F.explode(at)).withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    return out.select("*", F.col("_at.l").alias("_l"), F.col("_at.own").alias("_own")).drop("_at")


def meeting(a: DataFrame, b: DataFrame, columns_a: list[Column], columns_b: list[Column]) -> DataFrame:
    """Pairs of boxes that overlap or touch, each once; a and b have x0, x1, y0, y1 and level.  The columns are of aliases `a` and `b`."""
    left, right = _in_cells(a, levels(b)).alias("a"), _in_cells(b, levels(a)).alias("b")
    same = (F.col("a._l") == F.col("b._l")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col("a._own") | F.col("b._own"))
    size = F.pow(F.lit(2.0), F.col("a._l"))
    first = (F.floor(F.greatest("a.x0", "b.x0") / size) == F.col("a._cx")) & (F.floor(F.greatest("a.y0", "b.y0") / size) == F.col("a._cy"))
    touch = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    return left.join(right, same & first & touch).select(*columns_a, *columns_b)


def _pieces(pairs: DataFrame, polygons: DataFrame, name: str, side: str) -> DataFrame:
    """The edges of one polygon of each pair, cut at the borders of the pair's strips: strip, l, r (ends in x), yl, yr, s.

    s is the sign with which what lies below the edge counts: an area is the sum over edges of what lies below them.
    """
    e = polygons.select(F.col(name).alias(side), F.explode("edges").alias("e")).filter("e.ax <> e.bx")
    right = F.col("e.bx") > F.col("e.ax")
    e = e.select(
        side, F.least("e.ax", "e.bx").alias("lo"), F.greatest("e.ax", "e.bx").alias("hi"), F.when(right, F.col("e.ay")).otherwise(F.col("e.by")).alias("ylo"),
        F.when(right, F.col("e.by")).otherwise(F.col("e.ay")).alias("yhi"), F.when(right, -F.col("e.turn")).otherwise(F.col("e.turn")).alias("s"),
    )
    j = pairs.join(e, side).filter("hi > x0 AND lo < x1")
    first, last = F.floor((F.greatest("lo", "x0") - F.col("x0")) / F.col("w")), F.ceil((F.least("hi", "x1") - F.col("x0")) / F.col("w")) - 1
    last = F.least(F.greatest(last, F.lit(0)), F.col("n") - 1)
    j = j.withColumn("strip", F.explode(F.sequence(F.least(first, last), last)))
    border = lambda k: F.when(k >= F.col("n"), F.col("x1")).otherwise(F.col("x0") + k * F.col("w"))
    j = j.withColumn("l", F.greatest("lo", border(F.col("strip")))).withColumn("r", F.least("hi", border(F.col("strip") + 1))).filter("r > l")
    y = lambda x: F.col("ylo") + (F.col("yhi") - F.col("ylo")) * (x - F.col("lo")) / (F.col("hi") - F.col("lo")) - F.col("y0")
    return j.select("a", "b", "strip", "l", "r", y(F.col("l")).alias("yl"), y(F.col("r")).alias("yr"), "s")


def overlaps(a: DataFrame, name_a: str, b: DataFrame, name_b: str, least_share: float = 0.0) -> DataFrame:
    """a (name_a, parts), b (name_b, parts) -> name_a, name_b, area, share_a, share_b of the pairs whose overlap is more than nothing.

    What two polygons have in common is the sum, over their pairs of edges and with the edges' signs, of what lies below both; only edges of one strip
    meet.  Pairs with a share of the first polygon's area below least_share are left out, and those that merely touch: whose overlap is below
    a billionth of the smaller one.  Names tell polygons apart.
    """
    left, right = boxed(a, name_a), boxed(b, name_b)
    about = lambda x, n: [F.col(f"{x}.{n}").alias(x)] + [F.col(f"{x}.{c}").alias(f"{x}{c}") for c in ("x0", "x1", "y0")] + [F.size(f"{x}.edges").alias(f"{x}n"), area(F.col(f"{x}.edges")).alias(f"{x}area")]
    pairs = meeting(left, right, about("a", name_a), about("b", name_b))
    pairs = pairs.select("a", "b", "aarea", "barea", F.greatest("ax0", "bx0").alias("x0"), F.least("ax1", "bx1").alias("x1"), F.greatest("ay0", "by0").alias("y0"), F.least(F.ceil(F.least("an", "bn") / 4), F.lit(STRIPS)).alias("n")).filter("x1 > x0")
    narrow = pairs.select("a", "b", "x0", "x1", "y0", "n", ((F.col("x1") - F.col("x0")) / F.col("n")).alias("w"))
    p, q = _pieces(narrow, left, name_a, "a").alias("p"), _pieces(narrow, right, name_b, "b").alias("q")
    same = (F.col("p.a") == F.col("q.a")) & (F.col("p.b") == F.col("q.b")) & (F.col("p.strip") == F.col("q.strip")) & (F.col("p.l") < F.col("q.r")) & (F.col("q.l") < F.col("p.r"))
    met = p.join(q, same).withColumn("from_", F.greatest("p.l", "q.l")).withColumn("to_", F.least("p.r", "q.r"))
    at = lambda t, x: F.col(f"{t}.yl") + (F.col(f"{t}.yr") - F.col(f"{t}.yl")) * (x - F.col(f"{t}.l")) / (F.col(f"{t}.r") - F.col(f"{t}.l"))
    met = met.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), (F.col("p.s") * F.col("q.s")).alias("s"), (F.col("to_") - F.col("from_")).alias("w"), *[at(t, F.col(x)).alias(f"{t}{x[0]}") for t in "pq" for x in ("from_", "to_")])
    df, dt = F.col("pf") - F.col("qf"), F.col("pt") - F.col("qt")
    low, high = F.least("pf", "qf"), F.least("pt", "qt")
    part = df / F.nullif(df - dt, F.lit(0.0))
    cross = F.col("pf") + part * (F.col("pt") - F.col("pf"))
    below = F.when(df * dt < 0, part * (low + cross) / 2 + (1 - part) * (cross + high) / 2).otherwise((low + high) / 2) * F.col("w")
    found = met.groupBy("a", "b").agg(F.sum(F.col("s") * below).alias("area"))
    out = pairs.select("a", "b", "aarea", "barea").join(found, ["a", "b"]).filter(F.col("area") > 1e-9 * F.least("aarea", "barea"))
    out = out.select(F.col("a").alias(name_a), F.col("b").alias(name_b), "area", (F.col("area") / F.col("aarea")).alias("share_a"), (F.col("area") / F.col("barea")).alias("share_b"))
    return out.filter(F.col("share_a") >= least_share)


def points_in_polygons(points: DataFrame, key: str, polygons: DataFrame, name: str, snap: float) -> DataFrame:
    """points (key, x, y), polygons (name, parts) -> key, name, method.

    `inside`: the smallest name of those that hold the point; else `snapped`: the polygon whose boundary is nearest, up to `snap` away, of equally
    near ones the smallest name; else null and `none`, as for a null coordinate.  Points of one place are judged once.
    """
    boxes = boxed(polygons, name, snap)
    x, y = F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")
    at = points.filter("x IS NOT NULL AND y IS NOT NULL").select(x, y).distinct().repartition(TASKS, "_x", "_y").select("_x", "_y", F.col("_x").alias("x0"), F.col("_x").alias("x1"), F.col("_y").alias("y0"), F.col("_y").alias("y1"), F.lit(FINEST).alias("level"))
    met = meeting(at, boxes, [F.col("a._x"), F.col("a._y")], [F.col(f"b.{name}"), F.col("b.edges")])
    met = met.select("_x", "_y", name, holds(F.col("edges"), F.col("_x"), F.col("_y")).alias("_in"), distance(F.col("edges"), F.col("_x"), F.col("_y")).alias("_d"))
    best = met.filter(F.col("_in") | (F.col("_d") <= snap)).groupBy("_x", "_y").agg(F.min(F.struct((~F.col("_in")).alias("out"), F.when(F.col("_in"), 0.0).otherwise(F.col("_d")).alias("d"), F.col(name))).alias("_b"))
    method = F.when(F.col("_b").isNull(), "none").when(F.col("_b.out"), "snapped").otherwise("inside")
    return points.select(key, x, y).join(best, ["_x", "_y"], "left").select(key, F.col(f"_b.{name}").alias(name), method.alias("method"))
