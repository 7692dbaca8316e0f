"""Repeated stratified cross-validation of logistic models, imputed and scaled within each training part.

All models (one for each repeat and fold) are fitted at once, and with a lasso all strengths of its ladder too: a pass over the rows gives each one's gradient
and Gram matrix, added up in the tasks, and the driver solves equations of as many unknowns as there are features.  What reaches the driver is
repeats x folds x strengths x features squared numbers; strengths grow with the logarithm of the rows.  Nothing of a row is used in the model that scores it.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.draws import uniform
from lodestone.operators.prefix import running, saved, with_ranges

#: Twice the largest absolute linear score that is told from certainty.
FAR = 60.0


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, repeats: int, seed: int) -> DataFrame:
    """key, label, folds (the fold of each repeat): rows of a class are dealt in turn in the order of a random number, so its folds' sizes differ by one at most."""
    rows = df.filter(F.col(label).isNotNull()).select(key, label).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_u", uniform(seed, "_r", key))
    placed = running(with_ranges(rows, ["_r", label, "_u", key]), F.lit(1), ["_u", key], "_i", by=["_r", label])
    fold = F.pmod(F.col("_i") - 1, F.lit(folds)).cast("int")
    dealt = placed.groupBy(key, label).agg(F.array_sort(F.collect_list(F.struct("_r", fold.alias("f")))).alias("_f"))  # as many as repeats
    return dealt.select(key, label, F.transform("_f", lambda x: x["f"]).alias("folds"))


def _medians(rows: DataFrame, features: list[str], folds: int) -> DataFrame:
    """r, f, j, median of feature j among the rows outside fold f of repeat r; no row where all are null."""
    long = rows.select("folds", F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("j", "v")).filter("v IS NOT NULL")
    counts = long.select("j", "v", F.posexplode("folds").alias("r", "own")).groupBy("r", "j", "v", "own").agg(F.count("*").alias("n"))
    trained = counts.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("f <> own").groupBy("r", "f", "j", "v").agg(F.sum("n").alias("n"))
    run = running(with_ranges(trained, ["r", "f", "j", "v"]), F.col("n"), ["v"], "upto", by=["r", "f", "j"], total="all")
    low, high = F.col("all") / 2, F.floor(F.col("all") / 2) + 1
    middle = run.groupBy("r", "f", "j").agg(F.min(F.when(F.col("upto") >= low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") >= high, F.col("v"))).alias("b"))
    return middle.select("r", "f", "j", ((F.col("a") + F.col("b")) / 2).alias("median"))


@dataclass
class Models:
    """One model for each repeat and fold: medians, means, spreads and coefficients (the constant first) of the features; c: the inverse strength that each was fitted with."""

    features: list[str]
    folds: int
    median: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    c: np.ndarray


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features])


def _scaled(x: np.ndarray, median: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """A constant and the features, missing ones at the median, centred and scaled."""
    x = np.where(np.isnan(x), median, x)
    return np.column_stack([np.ones(len(x)), (x - mean) / spread])


def _summed(rows: DataFrame, each, models: int) -> np.ndarray:
    """Sum over all rows of each(batch) -> (models, n); a task sends one row a model."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = each(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(models, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["model", "x"])

    parts = rows.mapInArrow(run, "model int, x array<double>").select("model", F.posexplode("x").alias("i", "x"))
    got = parts.groupBy("model", "i").agg(F.sum("x")).collect()
    out = np.zeros((models, max((r[1] for r in got), default=-1) + 1))
    for m, i, v in got:
        out[m, i] = v
    return out


def _outside(batch: pa.RecordBatch, folds: int) -> np.ndarray:
    """Rows by models (repeat x fold): whether the row trains the model."""
    own = batch.column("folds").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return (own[:, :, None] != np.arange(folds)[None, None, :]).reshape(len(own), -1)


def _prepared(rows: DataFrame, features: list[str], folds: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = (repeats * folds, len(features))
    median = np.zeros(shape)  # a feature without a value in training counts as 0
    for r, f, j, m in _medians(rows, features, folds).collect():  # a row for each model and feature
        median[r * folds + f, j] = m

    def sums(batch):
        x, out = _matrix(batch, features), _outside(batch, folds)
        return np.stack([np.concatenate([[(out[:, m]).sum()], np.where(np.isnan(x), median[m], x)[out[:, m]].sum(0)]) for m in range(len(median))])

    first = _summed(rows, sums, shape[0])
    mean = first[:, 1:] / first[:, :1]

    def squares(batch):
        x, out = _matrix(batch, features), _outside(batch, folds)
        return np.stack([((np.where(np.isnan(x), median[m], x)[out[:, m]] - mean[m]) ** 2).sum(0) for m in range(len(median))])

    spread = np.sqrt(_summed(rows, squares, shape[0]) / first[:, :1])
    return median, mean, np.where(spread > 1e-12, spread, 1.0)


def _derivatives(rows: DataFrame, features: list[str], label: str, folds: int, median, mean, spread, of: np.ndarray, beta: np.ndarray):
    """Loss, gradient and Hessian of the training rows of each problem's model (of) at the problem's coefficients."""
    p = len(features) + 1

    def each(batch):
        x, out = _matrix(batch, features), _outside(batch, folds)
        y = batch.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False)
        got = np.zeros((len(of), 1 + p + p * p))
        for m in np.unique(of):
            z, t = _scaled(x[out[:, m]], median[m], mean[m], spread[m]), y[out[:, m]]
            for i in np.flatnonzero(of == m):
                eta = np.clip(z @ beta[i], -FAR, FAR)
                e = np.exp(-eta)
                mu = 1 / (1 + e)
                got[i] = np.concatenate([[(np.log1p(e) + (1 - t) * eta).sum()], z.T @ (mu - t), (z.T @ (z * (mu * (1 - mu))[:, None])).ravel()])
        return got

    s = _summed(rows, each, len(beta))
    return s[:, 0], s[:, 1 : p + 1], s[:, p + 1 :].reshape(-1, p, p)


def descend(gram: np.ndarray, gradient: np.ndarray, beta: np.ndarray, penalty: np.ndarray, sweeps: int = 2000, tolerance: float = 1e-12) -> np.ndarray:
    """The least of gradient.(b - beta) + (b - beta).gram.(b - beta) / 2 + sum of penalty |b|, coordinate by coordinate.

    After each sweep b goes to the least point for its signs, or towards it until one coordinate is 0: features that are nearly the same would take
    thousands of sweeps.
    """
    b = beta.copy()
    cost = lambda b: (gradient + gram @ (b - beta) / 2) @ (b - beta) + penalty @ abs(b)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            curve = gram[j, j]
            if curve <= 0:
                continue
            slope = gradient[j] + gram[j] @ (b - beta)
            at = b[j] - slope / curve
            new = np.sign(at) * max(0.0, abs(at) - penalty[j] / curve)
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tolerance:
            break
        on = np.flatnonzero(b)
        try:
            way = -np.linalg.solve(gram[np.ix_(on, on)], (gradient + gram @ (b - beta) + penalty * np.sign(b))[on])
        except np.linalg.LinAlgError:
            continue
        ends = (penalty[on] > 0) & (np.sign(b[on] + way) != np.sign(b[on]))
        share = np.where(ends, -b[on] / np.where(ends, way, 1), 1.0)
        least = share.min(initial=1.0)
        there = b.copy()
        there[on] += least * way
        there[on[ends & (share == least)]] = 0.0
        if cost(there) <= cost(b) + 1e-12 * max(1, abs(cost(b))):  # not where the equations have no single answer
            b = there
    return b


def _solved(derivatives, of: np.ndarray, beta: np.ndarray, objective_of, step_of, most: int, needed=None) -> np.ndarray:
    """Newton's steps of each problem (of: its model), halved where its objective grows; a pass serves all that are open and, by needed(beta, open), still of use."""
    beta, before, full = beta.copy(), beta.copy(), beta.copy()
    value, t, open_ = np.full(len(of), np.inf), np.ones(len(of)), np.ones(len(of), bool)
    for _ in range(most):
        at = np.flatnonzero(open_)
        for i, loss, gradient, hessian in zip(at, *derivatives(of[at], beta[at])):
            now = loss + objective_of(i, beta[i])
            if now > value[i] + 1e-10 * max(1, abs(value[i])) and t[i] > 1e-4:
                t[i] /= 2
                beta[i] = before[i] + t[i] * (full[i] - before[i])
            elif np.isfinite(value[i]) and np.abs(beta[i] - before[i]).max() <= 1e-9:
                open_[i] = False
            else:
                before[i], value[i], t[i] = beta[i], now, 1.0
                full[i] = step_of(i, hessian, gradient, beta[i])
                beta[i] = full[i]
        if needed:
            open_ &= needed(beta, open_)
        if not open_.any():
            break
    return beta


def fit(dealt: DataFrame, features: list[str], label: str, folds: int, c: float = 1.0, most_features: int | None = None, halvings: int | None = None, most: int = 60) -> Models:
    """dealt (folds, label 0/1, features) -> a model for each repeat and fold; features may be null.

    Without most_features a ridge penalty |b|^2 / (2 c) on all but the constant.  With it a lasso penalty |b| / c, the constant's too, with the largest c on
    c, c / 2, c / 4, .. that leaves at most so many features; halvings: that many values of c at most, else as many as it takes.
    """
    rows = saved(dealt.select("folds", F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in features]), "folds")
    repeats = rows.agg(F.max(F.size("folds"))).first()[0]
    if not repeats:
        raise ValueError("no labelled rows")
    prepared = _prepared(rows, features, folds, repeats)
    n, p = repeats * folds, len(features) + 1
    tiny, none = 1e-12 * np.eye(p), np.zeros((n, p))
    derivatives = lambda of, beta: _derivatives(rows, features, label, folds, *prepared, of, beta)
    if most_features is None:
        ridge = np.diag([0.0] + [1 / c] * (p - 1))
        beta = _solved(derivatives, np.arange(n), none, lambda i, b: b @ ridge @ b / 2, lambda i, h, g, b: b - np.linalg.solve(h + ridge + tiny, g + ridge @ b), most)
        return Models(features, folds, *prepared, beta, np.full(n, c))
    # features are centred, so what a constant alone leaves of their slopes doesn't depend on it: a penalty above the largest leaves no feature
    steepest = np.abs(derivatives(np.arange(n), none)[1][:, 1:]).max(initial=0.0)
    ladder = 2 + max(0, int(np.ceil(np.log2(max(1.0, c * steepest)))))
    strength = c * 0.5 ** np.arange(min(ladder, halvings or ladder))
    k = len(strength)
    few = lambda beta: (beta[:, 1:] != 0).sum(1).reshape(n, k) <= most_features
    at_least = lambda beta, open_: ~np.logical_or.accumulate(few(beta) & ~open_.reshape(n, k), axis=1).ravel()  # noqa: E731  stronger than one that will do
    lasso = lambda i: np.full(p, 1 / strength[i % k])
    beta = _solved(derivatives, np.repeat(np.arange(n), k), np.repeat(none, k, axis=0), lambda i, b: (lasso(i) * abs(b)).sum(), lambda i, h, g, b: descend(h + tiny, g, b, lasso(i)), most, at_least)
    at = np.where(few(beta).any(1), few(beta).argmax(1), k - 1)
    return Models(features, folds, *prepared, beta.reshape(n, k, p)[np.arange(n), at], strength[at])


def out_of_fold(dealt: DataFrame, key: str, models: Models) -> DataFrame:
    """dealt (key, folds, features) -> key, repeat, fold, score: the chance by the model whose training left the row out."""
    features, folds = models.features, models.folds
    kind = dealt.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch, features), np.array(batch.column("folds").to_pylist())
            for r in range(own.shape[1]):
                score = np.zeros(len(x))
                for f in range(folds):
                    at, m = own[:, r] == f, r * folds + f
                    score[at] = 1 / (1 + np.exp(-np.clip(_scaled(x[at], models.median[m], models.mean[m], models.spread[m]) @ models.beta[m], -FAR, FAR)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), r, np.int32)), pa.array(own[:, r].astype(np.int32)), pa.array(score)], [key, "repeat", "fold", "score"])

    wide = dealt.select(key, "folds", *[F.col(f).cast("double").alias(f) for f in features])
    return wide.mapInArrow(run, f"{key} {kind}, repeat int, fold int, score double")


def cross_validated(df: DataFrame, key: str, label: str, features: list[str], folds: int, repeats: int, seed: int, c: float = 1.0, most_features: int | None = None) -> tuple[DataFrame, Models]:
    """Out-of-fold scores of the rows that have a label (key, repeat, fold, score), and the models."""
    dealt = saved(stratified_folds(df, key, label, folds, repeats, seed).join(df.select(key, *features), key), "dealt")
    models = fit(dealt, features, label, folds, c, most_features)
    return out_of_fold(dealt, key, models), models
