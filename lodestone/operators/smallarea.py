"""Small-area estimates: cells fitted to margins, a logistic model with random intercepts, and its draws post-stratified to areas.

The driver holds coefficients, their covariance and draws of them, which grow with the number of columns and not with cells, groups or areas.
"""
from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.draws import BITS, uniform
from lodestone.operators.prefix import saved

#: Rounds of fitting between two writes, which cut the plan.
ROUNDS = 4


def dense(df: DataFrame, dims: list[str]) -> DataFrame:
    """All combinations of the dimensions' values; their number is the product of the numbers of values, so they must be few but for the first."""
    out = df.select(dims[0]).distinct()
    for d in dims[1:]:
        out = out.crossJoin(df.select(d).distinct())
    return out


def shares(counts: DataFrame, by: list[str], dims: list[str], n: str, out: str) -> DataFrame:
    """counts with out: n over its sum within `by`; where that is 0, the share of the dims' values over all groups; 0 where there is none either."""
    group = F.sum(n).over(Window.partitionBy(*by))
    of_all = counts.groupBy(*dims).agg(F.sum(n).alias("_d")).crossJoin(F.broadcast(counts.agg(F.sum(n).alias("_t")))).select(*dims, F.try_divide("_d", "_t").alias("_all"))
    joined = counts.withColumn("_g", group).join(of_all, dims, "left")
    return joined.withColumn(out, F.coalesce(F.when(F.col("_g") > 0, F.col(n) / F.col("_g")).otherwise(F.col("_all")), F.lit(0.0))).drop("_g", "_all")


Margin = tuple[list[str], DataFrame, str]


def raked(cells: DataFrame, weight: str, margins: list[Margin], rounds: int, within: list[str] | None = None) -> DataFrame:
    """cells with `weight` scaled, `rounds` times and margin by margin, so that it adds up to each margin's totals.

    A margin is (dims, a table of the dims, its column of totals); combinations that it lacks count as 0, and a group of cells whose weights are all 0 stays at 0.
    Where all margins have the dims `within`, cells are dealt by these once and no round shuffles.
    """
    df = cells.withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    for i, (dims, table, total) in enumerate(margins):
        df = df.join(table.select(*dims, F.col(total).cast("double").alias(f"_m{i}")), dims, "left")
    if within:
        df = df.repartition(*within)
    for r in range(rounds):
        for i, (dims, _, _) in enumerate(margins):
            s = F.sum("_w").over(Window.partitionBy(*dims))
            df = df.withColumn("_w", F.when(s > 0, F.col("_w") * F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) / s).otherwise(0.0))
        if r % ROUNDS == ROUNDS - 1 and r < rounds - 1:
            df = saved(df, "raked")
            df = df.repartition(*within) if within else df
    return df.select(*[F.col("_w").alias(c) if c == weight else F.col(c) for c in cells.columns])


def off_margins(cells: DataFrame, weight: str, margins: list[Margin]) -> DataFrame:
    """margin (its number), off: the largest difference of a margin's totals and the cells' sums, over the largest total."""
    out = None
    for i, (dims, table, total) in enumerate(margins):
        sums = cells.groupBy(*dims).agg(F.sum(weight).alias("_s"))
        both = sums.join(table.select(*dims, F.col(total).cast("double").alias("_m")), dims, "full").select(F.coalesce("_s", F.lit(0.0)).alias("s"), F.coalesce("_m", F.lit(0.0)).alias("m"))
        one = both.agg(F.lit(i).alias("margin"), F.try_divide(F.max(F.abs(F.col("s") - F.col("m"))), F.max(F.abs("m"))).alias("off"))
        out = one if out is None else out.union(one)
    return out


def raked_until(cells: DataFrame, weight: str, margins: list[Margin], tolerance: float = 1e-9, most: int = 200, within: list[str] | None = None) -> DataFrame:
    """raked() in steps of ROUNDS until all margins are met to the tolerance; an error if `most` rounds don't do it, as with margins that disagree."""
    for _ in range(0, most, ROUNDS):
        cells = saved(raked(cells, weight, margins, ROUNDS, within), "raked")
        if all((r["off"] or 0.0) <= tolerance for r in off_margins(cells, weight, margins).collect()):  # a row for each margin
            return cells
    raise ValueError(f"margins aren't met to {tolerance} after {most} rounds")


@dataclass
class Fit:
    """beta and its covariance by column; groups: group, u, h (precision of u given beta) and c (as much as u moves against beta), one row a group."""

    columns: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    groups: DataFrame
    log_likelihood: float
    converged: bool


def _dot(beta: np.ndarray, names: list[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, names, strict=True)), F.lit(0.0))


def _logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def _per_group(cells: DataFrame, groups: DataFrame, beta: np.ndarray, columns: list[str], group: str, sigma2: float) -> DataFrame:
    """For each group what its cells give to the objective, the gradient and the Hessian at beta and u."""
    p = range(len(columns))
    at = cells.join(groups.select(group, "u"), group).withColumn("_eta", _dot(beta, columns) + F.col("u")).withColumn("_mu", _logistic(F.col("_eta")))
    at = at.withColumn("_r", F.col("_y") - F.col("_n") * F.col("_mu")).withColumn("_v", F.col("_n") * F.col("_mu") * (1 - F.col("_mu")))
    softplus = F.greatest("_eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta")))
    sums = [F.sum(F.col("_n") * softplus - F.col("_y") * F.col("_eta")).alias("f"), F.sum("_r").alias("r"), F.sum("_v").alias("v")]
    sums += [F.sum(F.col(columns[j]) * F.col("_r")).alias(f"g{j}") for j in p] + [F.sum(F.col(columns[j]) * F.col("_v")).alias(f"c{j}") for j in p]
    sums += [F.sum(F.col(columns[j]) * F.col(columns[k]) * F.col("_v")).alias(f"H{j}_{k}") for j in p for k in p if k <= j]
    return at.groupBy(group, "u").agg(*sums).withColumn("h", F.col("v") + 1 / sigma2).withColumn("ru", F.col("r") - F.col("u") / sigma2)


def _mode(cells: DataFrame, groups: DataFrame, beta: np.ndarray, columns: list[str], group: str, sigma2: float, most: int):
    """Newton's steps, halved where the objective grows.  Groups are eliminated in each group's row, so the driver solves as many equations as columns."""
    p, before, t = range(len(columns)), None, 1.0
    for _ in range(most):
        stats = saved(_per_group(cells, groups, beta, columns, group, sigma2), "groups")
        total = [F.sum("f") + F.sum(F.col("u") * F.col("u")) / (2 * sigma2), F.sum(F.log(F.col("v") + 1 / sigma2)), F.count("*")]
        total += [F.sum(F.col(f"g{j}") - F.col(f"c{j}") * F.col("ru") / F.col("h")) for j in p] + [F.sum(F.col(f"H{j}_{k}") - F.col(f"c{j}") * F.col(f"c{k}") / F.col("h")) for j in p for k in p if k <= j]
        row = stats.agg(*[e.alias(f"s{i}") for i, e in enumerate(total)]).first()
        f, log_h, n = row[0], row[1], row[2]
        if before is not None and f > before[0] + 1e-10 and t > 1e-6:
            t /= 2
            _, old_beta, old_stats, step, move = before
        else:
            rhs = np.array([row[3 + j] for j in p])
            schur, at = np.zeros((len(columns),) * 2), 3 + len(columns)
            for j in p:
                for k in range(j + 1):
                    schur[j, k] = schur[k, j] = row[at]
                    at += 1
            ended = before is not None and (abs(before[0] - f) < 1e-12 * max(1.0, abs(f)))
            if ended:
                return beta, stats, schur, f, log_h, n, True
            t, old_beta, old_stats, step = 1.0, beta, stats, np.linalg.solve(schur, rhs)
            move = (F.col("ru") - sum((F.lit(float(d)) * F.col(f"c{j}") for j, d in enumerate(step)), F.lit(0.0))) / F.col("h")
            before = (f, old_beta, old_stats, step, move)
        beta, groups = old_beta + t * step, old_stats.select(group, (F.col("u") + t * move).alias("u"))
    return beta, stats, schur, f, log_h, n, False


def random_intercepts(cells: DataFrame, columns: list[str], hits: str, trials: str, group: str, sigma2: float | None = None, most: int = 60, exact: float = 1e-3) -> Fit:
    """A logistic model of hits among trials by the columns (give one of ones for a constant) and a random intercept for each group, by Laplace's approximation.

    Rows of equal columns and group are added up first.  Without sigma2 the intercepts' variance is the one between 1e-5 and 4 that makes the
    marginal likelihood largest, by golden sections of its logarithm up to `exact`.  Rows with a null or without trials are left out.
    """
    ok = F.col(group).isNotNull() & (F.col(trials) > 0) & F.col(hits).isNotNull()
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    rows = cells.filter(ok).groupBy(group, *[F.col(c).cast("double").alias(c) for c in columns]).agg(F.sum(F.col(hits).cast("double")).alias("_y"), F.sum(F.col(trials).cast("double")).alias("_n"))
    rows = saved(rows, "cells")
    start = saved(rows.select(group).distinct().withColumn("u", F.lit(0.0)), "groups")
    y, n = rows.agg(F.sum("_y"), F.sum("_n")).first()
    if not n or y in (0.0, n):
        raise ValueError("needs hits and misses")
    ones = [j for j, c in enumerate(columns) if rows.filter(F.col(c) != 1.0).isEmpty()]
    beta = np.zeros(len(columns))
    if ones:
        beta[ones[0]] = math.log(y / (n - y))
    known = {"beta": beta, "groups": start}

    def at(log_s2: float):
        s2 = math.exp(log_s2)
        beta, stats, schur, f, log_h, count, converged = _mode(rows, known["groups"], known["beta"], columns, group, s2, most)
        known.update(beta=beta, groups=stats.select(group, "u"))
        return f + 0.5 * count * log_s2 + 0.5 * log_h, beta, stats, schur, converged

    if sigma2 is None:
        low, high, golden = math.log(1e-5), math.log(4.0), (math.sqrt(5) - 1) / 2
        a, b = high - golden * (high - low), low + golden * (high - low)
        fa, fb = at(a)[0], at(b)[0]
        while high - low > exact:
            if fa <= fb:
                high, b, fb = b, a, fa
                a = high - golden * (high - low)
                fa = at(a)[0]
            else:
                low, a, fa = a, b, fb
                b = low + golden * (high - low)
                fb = at(b)[0]
        sigma2 = math.exp((low + high) / 2)
    marginal, beta, stats, schur, converged = at(math.log(sigma2))
    kept = stats.select(group, "u", "h", F.array(*[F.col(f"c{j}") / F.col("h") for j in range(len(columns))]).alias("c"))
    return Fit(list(columns), beta, np.linalg.inv(schur), sigma2, kept, -marginal, converged)


def _normal(one: Column, two: Column) -> Column:
    """A normal draw of two integers below 2 ** BITS."""
    u = lambda c: (c + 0.5) / float(1 << BITS)
    return F.sqrt(-2 * F.log(u(one))) * F.cos(2 * math.pi * u(two))


def normal(seed: int, *parts) -> float:
    """The same on the driver, of the md5 of seed, parts and 1 or 2."""
    u = [(int(hashlib.md5(":".join(map(str, (seed, *parts, k))).encode()).hexdigest()[: BITS // 4], 16) + 0.5) / (1 << BITS) for k in (1, 2)]
    return math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1])


def area_draws(fit: Fit, cells: DataFrame, area: str, group: str, people: str, draws: int, seed: int) -> DataFrame:
    """cells (area, group, the fit's columns, people) -> area, draw, rate, people: the cells' chances by each draw of the model, weighted by people.

    A draw takes coefficients from their normal approximation, then each group's intercept given these; a group that the fit
    lacks has one about 0.  Areas without people have no rate.
    """
    lower = np.linalg.cholesky(fit.cov)
    shift = [(lower @ np.array([normal(seed, d, c) for c in fit.columns])).tolist() for d in range(draws)]
    drawn = cells.sparkSession.createDataFrame([(d, *[float(b + s) for b, s in zip(fit.beta, shift[d], strict=True)], s2) for d, s2 in enumerate(shift)], ", ".join(["draw int", *[f"_b{j} double" for j in range(len(fit.columns))], "_shift array<double>"]))
    groups = cells.select(group).distinct().join(fit.groups, group, "left").withColumn("h", F.coalesce("h", F.lit(1 / fit.sigma2))).withColumn("u", F.coalesce("u", F.lit(0.0))).withColumn("c", F.coalesce("c", F.array(*[F.lit(0.0)] * len(fit.columns))))
    moved = F.aggregate(F.zip_with("c", "_shift", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    z = _normal(uniform(seed, "draw", group, F.lit(1)), uniform(seed, "draw", group, F.lit(2)))
    intercepts = groups.crossJoin(F.broadcast(drawn)).select(group, "draw", *[f"_b{j}" for j in range(len(fit.columns))], (F.col("u") - moved + z / F.sqrt("h")).alias("_u"))
    eta = sum((F.col(f"_b{j}") * F.col(c) for j, c in enumerate(fit.columns)), F.col("_u"))
    n = F.coalesce(F.col(people).cast("double"), F.lit(0.0))
    by_cell = cells.filter(F.col(group).isNotNull()).groupBy(area, group, *fit.columns).agg(F.sum(n).alias("_n")).join(intercepts, group)
    return by_cell.groupBy(area, "draw").agg(F.try_divide(F.sum(F.col("_n") * _logistic(eta)), F.sum("_n")).alias("rate"), F.sum("_n").alias("people"))


def summarised(drawn: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """drawn (by, draw, rate, people) -> by, mean, low, high, people: areas of one `by` weighted by their people in each draw."""
    tail = (1 - level) / 2
    each = drawn.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("rate") * F.col("people")), F.sum(F.when(F.col("rate").isNotNull(), F.col("people")))).alias("t"), F.sum("people").alias("people"))
    return each.groupBy(*by).agg(F.avg("t").alias("mean"), F.percentile("t", F.lit(tail)).alias("low"), F.percentile("t", F.lit(1 - tail)).alias("high"), F.max("people").alias("people"))
