"""Sums over all pairs of points by distance class, without writing pairs; the effective size of a correlated spatial sample.

Points of one place are one row first.  Places are numbered along a curve that keeps near ones together and dealt, a run of them at a time, to blocks; each pair of blocks
is a task, so that a place is shuffled once for every block and no pair is.  A task has a tree of boxes over either block: two boxes whose nearest and farthest corners lie in
one class are counted at once, from their numbers and sums; others go on as pairs of their children.  Only places of small boxes that a class border parts are met one by one.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.prefix import running, saved, with_ranges
from lodestone.operators.ranking import mid_rank

EARTH_KM = 6371.0088
#: Halvings of each axis that the curve tells apart, and places of two boxes that are met one by one (the square of a box's places).
LEVELS, LEAF = 16, 256
#: Places of a block at most, places of a block of few places, and of a run along the curve.
BLOCK, FEW, RUN = 1 << 16, 1 << 11, 512
#: Pairs of boxes and of places that a task looks at together, and steps of squared chords whose class is known beforehand.
TOGETHER, MET, STEPS = 1 << 14, 1 << 16, 1 << 14
AXES = "xyz"


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Unit vector of a place given in degrees."""
    a, o = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z")]


def _classes(chord: np.ndarray, band: float, last: int, sphere: bool) -> np.ndarray:
    d = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, chord / 2)) if sphere else chord
    return np.minimum(np.floor(d / band), last).astype(np.int64)


def _curve() -> Column:
    """A place's cell on the finest level as one number, whose high bits are those of its coarse cells."""
    bit = lambda a, k: F.shiftleft(F.shiftright(f"i{a}", k).bitwiseAND(1), 3 * k + AXES.index(a))
    return sum((bit(a, k) for k in range(LEVELS) for a in AXES), F.lit(0).cast("long"))


def _tree(at: np.ndarray, w: np.ndarray, leaf: int) -> tuple:
    """Places (m x 3) and their numbers and sums in the curve's order, filled up to whole leaves by places that count nothing; boxes from the leaves up, four to one."""
    more = -len(at) % leaf
    at, w = np.concatenate([at, np.repeat(at[-1:], more, 0)]), np.concatenate([w, np.zeros((more, w.shape[1]))])
    low, high, sums = (f(v.reshape(len(at) // leaf, leaf, -1), axis=1) for f, v in ((np.min, at), (np.max, at), (np.sum, w)))
    levels = [(low, high, sums)]
    while len(low) > 1:
        cut = np.arange(0, len(low), 4)
        low, high, sums = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.add.reduceat(sums, cut)
        levels.append((low, high, sums))
    return at.reshape(-1, leaf, 3), w.reshape(-1, leaf, w.shape[1]), levels


def _block_sums(a: tuple, b: tuple | None, band: float, last: int, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """By class: ordered pairs, and sums of products, over the pairs of two trees' places, or of one's."""
    one, b = b is None, a if b is None else b
    (at, aw, au), (bt, bw, bu) = a, b
    values = (aw.shape[2] - 1) // 2
    # what is known of a squared chord by its step: the least and the largest class there, with room for rounding
    top = min(2.0, 2 * math.sin(min(math.pi, last * band / EARTH_KM) / 2)) if sphere else last * band
    scale = STEPS / ((top * 1.001) ** 2 or 1.0)
    edge = np.sqrt(np.arange(STEPS + 1) / scale)
    border = np.array([2 * math.sin(min(math.pi, k * band / EARTH_KM) / 2) if sphere else k * band for k in range(last + 1)])
    least, most = _classes(edge[:-1] * (1 - 1e-9), band, last, sphere), _classes(edge[1:] * (1 + 1e-9), band, last, sphere)
    least[-1], most[-1] = _classes(edge[-2:-1] * (1 - 1e-9), band, last, sphere)[0], last
    step = lambda c: np.minimum(c * scale, STEPS - 1).astype(np.int32)
    pairs, sums = np.zeros(last + 1, np.int64), np.zeros((last + 1, values))

    def add(kind: np.ndarray, n: np.ndarray, products: list[np.ndarray]) -> None:
        pairs[:] += np.rint(np.bincount(kind, n, last + 1)).astype(np.int64)
        for v, x in enumerate(products):
            sums[:, v] += np.bincount(kind, x, last + 1)

    def by_place(i: np.ndarray, j: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        chord = np.zeros((len(i), at.shape[1], bt.shape[1]))
        for k in range(3):
            gap = at[i, :, k][:, :, None] - bt[j, :, k][:, None, :]
            gap *= gap
            chord += gap
        one_leaf = one & (i == j)
        x, y, times = aw[i][:, :, : 1 + values], bw[j][:, :, : 1 + values], np.where(one_leaf, 1.0, 2.0)
        two = far == near + 1
        if two.all():  # a border parts the places of each pair of leaves: sums on its nearer side, the rest is beyond
            low, high = (((border[far] * f) ** 2)[:, None, None] for f in (1 - 1e-9, 1 + 1e-9))
            nearer = chord < low
            unsure = np.nonzero((chord < high) & ~nearer)
            nearer[unsure] = _classes(np.sqrt(chord[unsure]), band, last, sphere) <= near[unsure[0]]
            inner = ((nearer.astype(np.float64) @ y) * x).sum(1) * times[:, None]
            outer = y.sum(1) * x.sum(1) * times[:, None] - inner
            add(np.concatenate([near, far]), np.concatenate([inner[:, 0], outer[:, 0]]), list(np.concatenate([inner[:, 1:], outer[:, 1:]]).T))
        else:
            chord = chord.ravel()
            known = step(chord)
            kind = least[known]
            unsure = np.flatnonzero(kind != most[known])
            kind[unsure] = _classes(np.sqrt(chord[unsure]), band, last, sphere)
            product = lambda c: ((x[:, :, c] * times[:, None])[:, :, None] * y[:, None, :, c]).ravel()
            add(kind, product(0), [product(1 + v) for v in range(values)])
        same = aw[i[one_leaf]].reshape(-1, aw.shape[2]).sum(0)  # a point is no pair with itself
        pairs[0] -= round(same[0])
        sums[0] -= same[1 + values :]

    top_level = max(len(au), len(bu)) - 1
    level_of = lambda u, k: u[min(k, len(u) - 1)]
    todo = [(top_level, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > TOGETHER:
            todo += [(level, i[:TOGETHER], j[:TOGETHER]), (level, i[TOGETHER:], j[TOGETHER:])]
            continue
        (al, ah, an), (bl, bh, bn) = level_of(au, level), level_of(bu, level)
        al, ah, bl, bh = al[i], ah[i], bl[j], bh[j]
        near, far = (np.maximum(np.maximum(al - bh, bl - ah), 0.0) ** 2).sum(1), (np.maximum(ah - bl, bh - al) ** 2).sum(1)
        kind, farthest = least[step(near)], most[step(far)]
        done = kind == farthest
        p, q = an[i[done]], bn[j[done]]
        same = one & (i[done] == j[done])
        add(kind[done], np.where(same, p[:, 0] * (p[:, 0] - 1), 2 * p[:, 0] * q[:, 0]), [np.where(same, p[:, 1 + v] ** 2 - p[:, 1 + values + v], 2 * p[:, 1 + v] * q[:, 1 + v]) for v in range(values)])
        i, j, kind, farthest = i[~done], j[~done], kind[~done], farthest[~done]
        if level == 0:
            for two in (True, False):
                at_once = np.flatnonzero((farthest == kind + 1) == two)
                for k in range(0, len(at_once), MET // LEAF + 1):
                    few = at_once[k : k + MET // LEAF + 1]
                    by_place(i[few], j[few], kind[few], farthest[few])
        elif len(i):
            child = lambda u, x: (4 * x[:, None] + np.arange(4), len(u[level - 1][0])) if level < len(u) else (np.stack([x, *[x + 1] * 3], 1), 1)  # noqa: B023, E731
            (ci, ni), (cj, nj) = child(au, i), child(bu, j)
            ci, cj = np.repeat(ci, 4, 1).ravel(), np.tile(cj, (1, 4)).ravel()
            ok = (ci < ni) & (cj < nj) & ((ci <= cj) if one else True)
            todo.append((level - 1, ci[ok], cj[ok]))
    return pairs, sums


def pair_sums(points: DataFrame, values: list[str], band: float, longest: float, sphere: bool) -> DataFrame:
    """points (x, y, z, values) -> class, pairs (ordered ones), and for each value v `s_v`: the sum of its products over those pairs.

    Class k holds distances from k * band to less than (k + 1) * band; beyond `longest` there is one class.  With `sphere` x, y, z are unit vectors and distances
    kilometres along the earth.  Classes without pairs have no row; points with a null are left out.
    """
    last, leaf = int(longest // band), math.isqrt(LEAF)
    ok = F.lit(True)
    for c in [*AXES, *values]:
        ok = ok & F.col(c).isNotNull()
    sums = [f"{k}_{v}" for k in "sq" for v in values]
    square = {"s": lambda v: F.col(v).cast("double"), "q": lambda v: F.pow(F.col(v).cast("double"), F.lit(2))}
    places = points.filter(ok).groupBy(*[F.col(a).cast("double").alias(a) for a in AXES]).agg(F.count("*").cast("double").alias("n"), *[F.sum(square[c[0]](c[2:])).alias(c) for c in sums])
    places = saved(places, "places")
    low = places.agg(F.count("*").alias("m"), *[F.min(a).alias(f"l{a}") for a in AXES], F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("side")).first()
    shape = "class int, pairs long, " + ", ".join(f"s_{v} double" for v in values)
    if not low["m"]:
        return points.sparkSession.createDataFrame([], shape)
    side = (low["side"] or 1.0) * (1 + 1e-9)
    at = lambda a: F.floor((F.col(a) - F.lit(low[f"l{a}"])) / side * (1 << LEVELS)).cast("long").alias(f"i{a}")
    placed = places.select("*", *[at(a) for a in AXES]).select("*", _curve().alias("_m"))
    order = ["_m", *AXES]
    numbered = running(with_ranges(placed, order), F.lit(1), order, "_i")
    blocks = max(-(-low["m"] // BLOCK), min(16, -(-low["m"] // FEW)))
    block = F.shiftright(F.col("_i") - 1, RUN.bit_length() - 1) % blocks
    dealt = saved(numbered.select(block.cast("int").alias("_b"), "_i", *AXES, "n", *sums), "blocks")
    met = dealt.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_task", F.least("_b", "_c") * blocks + F.greatest("_b", "_c")).drop("_c")

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        b = table.column("_b").to_numpy()
        numbers = np.stack([table.column(c).to_numpy() for c in (*AXES, "n", *sums)], 1)
        trees = [_tree(numbers[b == k, :3], numbers[b == k, 3:], leaf) for k in np.unique(b)]
        task = table.column("_task")[0].as_py()
        if task // blocks != task % blocks and len(trees) < 2:
            trees = []
        pairs, total = _block_sums(trees[0], trees[1] if len(trees) > 1 else None, band, last, sphere) if trees else (np.zeros(last + 1, np.int64), np.zeros((last + 1, len(values))))
        kinds = np.flatnonzero(pairs)
        return pa.table({"class": pa.array(kinds.astype(np.int32)), "pairs": pa.array(pairs[kinds]), **{f"s_{v}": pa.array(total[kinds, k]) for k, v in enumerate(values)}})

    # a pair of blocks is a group; more partitions than groups, so that few share one
    found = met.repartition(2 * blocks * (blocks + 1), "_task").groupBy("_task").applyInArrow(summed, shape)
    return found.groupBy("class").agg(F.sum("pairs").alias("pairs"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values]).filter("pairs > 0")


def student_p(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def effective_n(points: DataFrame, x: str, y: str, lat: str, lon: str, band_km: float = 100.0, longest_km: float = 2000.0) -> DataFrame:
    """One row: n, rho (Spearman's), n_eff, p: the size that a sample without spatial structure would need for the variance of rho, after Clifford, Richardson and Hemon.

    The variance is (n + sum over distance classes of pairs times both variables' autocorrelations) / n ** 2, on ranks; n_eff lies between 3 and n.  Rows with a null are left
    out; with fewer than five n_eff and p are null.
    """
    rows = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(x).alias("_vx"), F.col(y).alias("_vy"), *on_sphere(F.col(lat), F.col(lon)))
    ranked = mid_rank(mid_rank(saved(rows, "points"), "_vx", "_rx"), "_vy", "_ry")
    mean = F.broadcast(ranked.agg(F.avg("_rx").alias("_mx"), F.avg("_ry").alias("_my")))
    centred = saved(ranked.crossJoin(mean).select(*AXES, (F.col("_rx") - F.col("_mx")).alias("u"), (F.col("_ry") - F.col("_my")).alias("v")), "ranks")
    whole = centred.agg(F.count("*").alias("n"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("u") * F.col("v")).alias("uv")).first()
    n, spread = whole["n"], (whole["uu"] or 0.0) * (whole["vv"] or 0.0)
    rho = whole["uv"] / math.sqrt(spread) if spread > 0 else None
    shape = "n long, rho double, n_eff double, p double"
    if n < 5 or rho is None:
        return points.sparkSession.createDataFrame([(n, rho, None, None)], shape)
    sums = pair_sums(centred, ["u", "v"], band_km, longest_km, True)
    scale = (whole["uu"] / n) * (whole["vv"] / n)
    extra = sums.agg(F.sum(F.col("s_u") * F.col("s_v") / F.col("pairs"))).first()[0] or 0.0
    variance = (n + extra / scale) / n**2
    size = min(max(1 + 1 / variance, 3.0), float(n)) if variance > 0 else float(n)
    t = rho * math.sqrt((size - 2) / max(1e-12, 1 - rho * rho))
    return points.sparkSession.createDataFrame([(n, rho, size, student_p(abs(t), size - 2))], shape)
