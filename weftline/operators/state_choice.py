"""Hidden Markov models of several state counts and hold-outs, fitted side by side.

Every state count has one model of all rows and one for each held-out stretch. A pass over the rows serves all of them:
a chunk of rows gives each model's transfer matrix, a short fold over a session's chunks gives the chances at their ends,
and a second pass turns each chunk into sums of a fixed size, added up in the tasks. No row leaves a pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.chains import Group, packed, sums
from weftline.operators.hmm import information, sticky
from weftline.sources.scratch import written


def stretch(i: str, n: str, folds: int) -> Column:
    """The contiguous stretch (0 to folds - 1) of row i of n: the first n % folds stretches have a row more; with n under
    `folds` the last ones are empty."""
    size, more = F.floor(F.col(n) / folds), F.col(n) % folds
    long = more * (size + 1)
    return F.when(F.col(i) < long, F.floor(F.col(i) / (size + 1))).otherwise(more + F.floor((F.col(i) - long) / F.greatest(size, F.lit(1)))).cast("int")


def _step(g: Group, got: np.ndarray, inputs: int, prior: float, stay: float, ridge: float) -> Group:
    """The next parameters. Least squares by state; logistic weights go one step along the slope, scaled by a bound of the
    curvature (a quarter of the products), which never lowers the likelihood."""
    f, k, q = len(g.out), g.states, inputs + 1
    at = np.cumsum([4, k * k, k, k * (q + 1) ** 2])
    moves = got[:, at[0] : at[1]].reshape(f, k, k) + prior * sticky(k, stay) + 1e-9
    start = got[:, at[1] : at[2]] + 1e-9
    product = got[:, at[2] : at[3]].reshape(f, k, q + 1, q + 1)
    inner = product[:, :, :q, :q] + 1e-9 * np.eye(q)
    if g.deviations is None:
        slope = got[:, at[3] :].reshape(f, k, q) - ridge * g.weights
        weights, deviations = g.weights + np.linalg.solve(0.25 * inner + ridge * np.eye(q), slope[..., None])[..., 0], None
    else:
        weights = (np.linalg.pinv(inner, hermitian=True) @ product[:, :, :q, q, None])[..., 0]
        left = product[:, :, q, q] - 2 * np.einsum("fsa,fsa->fs", weights, product[:, :, :q, q]) + np.einsum("fsa,fsab,fsb->fs", weights, product[:, :, :q, :q], weights)
        deviations = np.sqrt(np.maximum(left, 1e-9) / np.maximum(product[:, :, 0, 0], 1e-9))
    return Group(k, g.out, weights, deviations, moves / moves.sum(axis=2, keepdims=True), start / start.sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Fitted:
    """One model with its figures: of the rows it learnt from (loglik, n), and of those held out (-1: none)."""

    states: int
    out: int
    weights: np.ndarray
    deviations: np.ndarray | None
    transitions: np.ndarray
    start: np.ndarray
    loglik: float
    n: int
    held_loglik: float
    held_n: int
    steps: int


def sweep(rows: DataFrame, states: Sequence[int], folds: int = 5, logistic: bool = False, steps: int = 100, tolerance: float = 1e-4, prior: float = 0.0, stay: float = 0.9, ridge: float = 1e-4, chunk: int = 4096) -> list[Fitted]:
    """Models of each state count over rows (session, i from 0 without gaps, x array, y): one of all rows and one for
    each of `folds` contiguous stretches of every session, which it does not see.

    Fits start at quantiles of y (logistic: levels from -1 to 1), learn the start chances too, and end when the mean
    log-likelihood gains less than the tolerance, or after `steps`; figures are those of the parameters returned. A
    null y has no defined result; an empty table or a y without spread gives no models.
    """
    first = rows.agg(F.max(F.size("x")).alias("p"), F.stddev_pop("y").alias("s"), F.max("i").alias("last")).first()
    if first["p"] is None or not first["s"]:
        return []
    p, cuts = first["p"], sorted({(j + 0.5) / k for k in states for j in range(k)})
    level = dict(zip(cuts, [0.0] * len(cuts) if logistic else rows.approxQuantile("y", cuts, 1e-3), strict=True))
    groups = []
    for k in states:
        out, weights = np.arange(-1, folds), np.zeros((folds + 1, k, 1 + p))
        weights[:, :, 0] = np.linspace(-1, 1, k) if logistic and k > 1 else [level[(j + 0.5) / k] for j in range(k)]
        groups.append(Group(k, out, weights, None if logistic else np.full((folds + 1, k), first["s"]), np.tile(sticky(k, stay), (folds + 1, 1, 1)), np.full((folds + 1, k), 1 / k)))
    data = rows.select("session", F.col("i").cast("bigint").alias("i"), F.transform("x", lambda v: v.cast("double")).alias("x"), F.col("y").cast("double").alias("y"))
    lengths = data.groupBy(F.col("session").alias("_s")).agg(F.count("*").alias("n"))
    data = data.join(lengths, F.col("session").eqNullSafe(F.col("_s"))).drop("_s")
    done, before = [], [np.full(folds + 1, -math.inf) for _ in groups]
    with written(packed(data, chunk, ["x"], ["y"], ["n"])) as held:
        for n in range(steps + 1):
            found, going, since = sums(held, groups, p, first["last"] < chunk, folds), [], []
            for g, got, b in zip(groups, found, before, strict=True):
                end = (got[:, 0] - b < tolerance * np.maximum(got[:, 1], 1)) | (n == steps)
                for j in np.flatnonzero(end):
                    done.append(Fitted(g.states, int(g.out[j]), g.weights[j], None if g.deviations is None else g.deviations[j], g.transitions[j], g.start[j], float(got[j, 0]), int(got[j, 1]), float(got[j, 2]), int(got[j, 3]), n))
                if not end.all():
                    going.append(_step(g.part(~end), got[~end], p, prior, stay, ridge))
                    since.append(got[~end, 0])
            groups, before = going, since
            if not groups:
                break
    return sorted(done, key=lambda m: (m.states, m.out))


def scores(spark, models: Sequence[Fitted]) -> DataFrame:
    """By state count: log-likelihood of all rows, number of parameters, AIC, BIC, and mean and standard error over the
    held-out stretches of the log-likelihood a row that they have; stretches without rows do not count."""
    cells = []
    for k in sorted({m.states for m in models}):
        whole = next(m for m in models if m.states == k and m.out < 0)
        held = np.array([m.held_loglik / m.held_n for m in models if m.states == k and m.out >= 0 and m.held_n])
        told = information(k, whole.weights.shape[1] - 1, whole.loglik, whole.n)
        cells.append((k, whole.n, whole.loglik, told["parameters"], told["aic"], told["bic"], len(held), float(held.mean()) if len(held) else None, float(held.std() / math.sqrt(len(held))) if len(held) else None, whole.steps))
    return spark.createDataFrame(cells, "states int, n bigint, loglik double, parameters int, aic double, bic double, stretches int, held_out double, held_out_error double, steps int")


def lengths_of(rows: DataFrame, folds: int) -> DataFrame:
    """Session, fold, first row and rows of every held-out stretch."""
    n = F.count("*").over(Window.partitionBy("session"))
    return rows.select("session", "i", n.alias("_n")).groupBy("session", stretch("i", "_n", folds).alias("fold")).agg(F.min("i").alias("first"), F.count("*").alias("n"))
