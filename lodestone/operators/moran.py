"""Neighbours by boundaries, Moran's I and its permutation nulls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import polygons
from lodestone.operators.draws import uniform
from lodestone.operators.prefix import running, saved, with_ranges


def contiguous(areas: DataFrame, name: str, gap: float) -> DataFrame:
    """areas (name, parts) -> a, b: ordered pairs of areas whose boundaries come within `gap` of each other or cross, or of which one lies in the other.

    Boxes meet on the grid; then edges meet that come near the other area's box.
    """
    boxes = polygons.boxed(areas, name, gap)
    of = lambda x: [F.col(f"{x}.{name}").alias(x)] + [F.col(f"{x}.{c}").alias(f"{x}{c}") for c in ("x0", "x1", "y0", "y1")]
    pairs = polygons.meeting(boxes, boxes, of("a"), of("b")).filter("a < b")
    box = [F.greatest(f"a{c}", f"b{c}").alias(c) if c.endswith("0") else F.least(f"a{c}", f"b{c}").alias(c) for c in ("x0", "x1", "y0", "y1")]
    pairs = pairs.select("a", "b", *box)
    edge = boxes.select(name, F.explode("edges").alias("e"))
    near = lambda x: (F.least("e.ax", "e.bx") <= F.col("x1")) & (F.greatest("e.ax", "e.bx") >= F.col("x0")) & (F.least("e.ay", "e.by") <= F.col("y1")) & (F.greatest("e.ay", "e.by") >= F.col("y0"))
    p = pairs.join(edge.select(F.col(name).alias("a"), "e"), "a").filter(near("a")).select("a", "b", F.col("e").alias("p"))
    q = pairs.join(edge.select(F.col(name).alias("b"), "e"), "b").filter(near("b")).select("a", "b", F.col("e").alias("q"))

    def from_edge(x: Column, y: Column, e: str) -> Column:
        dx, dy = F.col(f"{e}.bx") - F.col(f"{e}.ax"), F.col(f"{e}.by") - F.col(f"{e}.ay")
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(((x - F.col(f"{e}.ax")) * dx + (y - F.col(f"{e}.ay")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return F.sqrt(F.pow(F.col(f"{e}.ax") + t * dx - x, F.lit(2)) + F.pow(F.col(f"{e}.ay") + t * dy - y, F.lit(2)))

    turn = lambda e, f, s: F.signum((F.col(f"{e}.bx") - F.col(f"{e}.ax")) * (F.col(f"{f}.{s}y") - F.col(f"{e}.ay")) - (F.col(f"{e}.by") - F.col(f"{e}.ay")) * (F.col(f"{f}.{s}x") - F.col(f"{e}.ax")))
    cross = (turn("p", "q", "a") * turn("p", "q", "b") < 0) & (turn("q", "p", "a") * turn("q", "p", "b") < 0)
    ends = F.least(*[from_edge(F.col(f"{o}.{s}x"), F.col(f"{o}.{s}y"), e) for e, o in (("p", "q"), ("q", "p")) for s in "ab"])
    touch = p.join(q, ["a", "b"]).filter(cross | (ends <= gap)).select("a", "b").distinct()
    return touch.union(touch.select(F.col("b").alias("a"), F.col("a").alias("b")))


def morans_i(values: DataFrame, key: str, x: str, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, t: n / S0 times the sum over edges (a, b) of weighted products of deviations over their sum of squares, weights 1 over a node's neighbours; nodes without a value or neighbours are left out."""
    by = by or []
    known = values.filter(F.col(x).isNotNull()).select(*by, F.col(key).alias("a"), F.col(x).cast("double").alias("_x"))
    nodes = known.select("a").distinct()
    linked = edges.filter("a <> b").select("a", "b").distinct().join(nodes, "a", "left_semi").join(nodes.select(F.col("a").alias("b")), "b", "left_semi")
    linked = saved(linked, "linked")
    weighted = linked.join(linked.groupBy("a").agg((1 / F.count("*")).alias("_w")), "a")
    known = known.join(linked.select("a").distinct(), "a", "left_semi")
    mean = known.groupBy(*by).agg(F.avg("_x").alias("_m"))
    z = known.join(mean, by) if by else known.crossJoin(F.broadcast(mean))
    z = z.select(*by, "a", (F.col("_x") - F.col("_m")).alias("_z"))
    below = z.groupBy(*by).agg(F.sum(F.col("_z") * F.col("_z")).alias("_d"))
    above = weighted.join(z, "a").join(z.select(*by, F.col("a").alias("b"), F.col("_z").alias("_y")), [*by, "b"]).groupBy(*by).agg(F.sum(F.col("_w") * F.col("_z") * F.col("_y")).alias("_n"))
    both = above.join(below, by) if by else above.crossJoin(below)
    # rows of the weights add up to 1, so S0 is the number of nodes
    return both.select(*by, F.try_divide("_n", "_d").alias("t"))


def permuted(values: DataFrame, key: str, x: str, draws: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """draw, key, x with the values dealt anew in each draw, within strata: the i-th key gets the value of the key whose random number is the i-th."""
    by = ["draw", *(strata or [])]
    rows = values.filter(F.col(x).isNotNull()).select(F.col(key), F.col(x), *(strata or [])).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", uniform(seed, "draw", key))
    rows = saved(rows, "draws")
    to = running(with_ranges(rows.drop(x, "_u"), [*by, key]), F.lit(1), [key], "_i", by=by).select(*by, key, "_i")
    dealt = running(with_ranges(rows, [*by, "_u", key]), F.lit(1), ["_u", key], "_i", by=by).select(*by, x, "_i")
    return to.join(dealt, [*by, "_i"]).select("draw", key, x)


def moran_null(values: DataFrame, key: str, x: str, edges: DataFrame, draws: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """draw, t, observed: Moran's I of the values dealt anew among the nodes that have neighbours."""
    edges = saved(edges.select("a", "b"), "edges")  # used in every draw
    linked = edges.filter("a <> b").select(F.col("a").alias(key)).distinct()
    kept = saved(values.join(linked, key, "left_semi"), "values")
    observed = morans_i(kept, key, x, edges).select(F.col("t").alias("observed"))
    return morans_i(saved(permuted(kept, key, x, draws, seed, strata), "dealt"), key, x, edges, ["draw"]).crossJoin(F.broadcast(observed))


def adjusted_effect(df: DataFrame, y: str, case: Column, covariates: list[str]) -> DataFrame:
    """One row: effect, se, t, n: the difference of cases and others in y at equal covariates, by least squares, with the HC3 standard error; rows with a null are left out."""
    from numpy import array, linalg

    names = ["_one", "_case", *[f"_c{i}" for i in range(len(covariates))]]
    rows = df.select(F.lit(1.0).alias("_one"), case.cast("double").alias("_case"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(covariates)], F.col(y).cast("double").alias("_y")).dropna()
    rows = saved(rows, "rows")
    k = range(len(names))
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i in k for j in k if j <= i], *[F.sum(F.col(c) * F.col("_y")).alias(f"y{i}") for i, c in enumerate(names)]).first()
    shape = "effect double, se double, t double, n long"
    if sums["n"] <= len(names):
        return df.sparkSession.createDataFrame([(None, None, None, sums["n"])], shape)
    inverse = linalg.pinv(array([[sums[f"x{max(i, j)}_{min(i, j)}"] for j in k] for i in k]))
    beta = inverse @ array([sums[f"y{i}"] for i in k])
    fitted = sum(float(b) * F.col(c) for b, c in zip(beta, names, strict=True))
    lever = sum(float(inverse[i, j]) * F.col(names[i]) * F.col(names[j]) for i in k for j in k)
    pull = sum(float(inverse[1, j]) * F.col(names[j]) for j in k)  # how much a row's y moves the effect
    variance = rows.agg(F.sum(F.pow(pull * (F.col("_y") - fitted) / (1 - lever), F.lit(2)))).first()[0]
    se = variance**0.5 if variance is not None else None
    return df.sparkSession.createDataFrame([(float(beta[1]), se, float(beta[1]) / se if se else None, sums["n"])], shape)


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: rho (Spearman's of x and y at equal ranks of z) and n, over rows that have all three."""
    from lodestone.operators.ranking import percentile_ranks

    rows = saved(df.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))]).dropna(), "rows")
    r = percentile_ranks(rows, {"x": "_x", "y": "_y", "z": "_z"}).agg(F.corr("_x", "_y").alias("xy"), F.corr("_x", "_z").alias("xz"), F.corr("_y", "_z").alias("yz"), F.count("*").alias("n"))
    below = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), below).alias("rho"), "n")


def first_in_period(df: DataFrame, by: str, day: str, start_month: int) -> DataFrame:
    """by, first: the earliest fiscal year, which begins in start_month and is named after the calendar year in which it ends (the calendar year for 1)."""
    year = F.year(day) + (F.lit(1) if start_month > 1 else F.lit(0)) * (F.month(day) >= start_month).cast("int")
    return df.groupBy(by).agg(F.min(year).alias("first"))
