"""Many generalised linear models at a time: one scan of the rows gives the sums of all models' next step.

A model is a response, a held-out fold, a cell (such as a time bin), a set of columns and a penalty. A task adds up loss,
gradient and curvature of every model over its rows; the sums are added by model in two shuffles, whose tasks also take the
proximal Newton step. What reaches the driver is each model's weights, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.scratch import written

#: The most numbers of curvature (8 bytes each) that a task holds; further models have a scan of their own.
HELD = 1 << 24
#: Partial sums that one task adds up at a time.
FAN_IN = 64
#: The most weights that are broadcast when rows are scored.
BROADCAST_WEIGHTS = 1 << 22
_NO_FOLD = -(1 << 31)


@dataclass(frozen=True)
class Model:
    """Row's `response`-th y on the columns of x (None: all), fitted without `fold` (None: on all rows) on the rows of `cell`.

    The penalty is on the weights of scaled columns, not on the intercept: penalty * (mix * |w| + (1 - mix) / 2 * w^2).
    """

    response: int = 0
    fold: int | None = None
    cell: int = 0
    columns: tuple[int, ...] | None = None
    penalty: float = 0.0
    mix: float = 0.0


@dataclass
class Fit:
    """A fitted model in the scale of the rows. status: ok, no_rows, missing_class (logistic), all_zero (Poisson), not_converged."""

    model: Model
    status: str
    n: float = 0.0
    loss: float = math.nan
    intercept: float = math.nan
    weights: list[float] = field(default_factory=list)
    passes: int = 0


def laid(rows: DataFrame, y: Column, x: str = "x", fold: str | None = "fold", cell: str | None = None, weight: str | None = None) -> DataFrame:
    """rows as `fit` reads them: cell, fold, w, y (array<double>, null where a response is not there), x.

    A vector that is null or holds null or non-finite values, a null cell and a weight that is null or not over 0 leave the
    row out. A row with a null fold is in no model with a held-out fold. Vectors have one length.
    """
    at = F.coalesce(F.col(fold).cast("int"), F.lit(_NO_FOLD)) if fold else F.lit(_NO_FOLD)
    out = rows.select((F.col(cell) if cell else F.lit(0)).cast("int").alias("cell"), at.alias("fold"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), y.cast("array<double>").alias("y"), F.col(x).cast("array<double>").alias("x"))
    return out.where("cell IS NOT NULL AND w > 0 AND x IS NOT NULL AND y IS NOT NULL").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = len(b)
    flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return b.column("cell").to_numpy(), b.column("fold").to_numpy(), b.column("w").to_numpy(), flat("y"), flat("x")


def _merge(a: tuple, b: tuple) -> tuple:
    """Two parts' (weight, squared weight, weighted y, least y, largest y, means, squared deviations) as one."""
    n = a[0] + b[0]
    d = b[5] - a[5]
    return n, a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]), a[5] + d * (b[0] / n), a[6] + b[6] + d * d * (a[0] * b[0] / n)


_MOMENTS = "cell int, fold int, response int, n double, n2 double, sy double, low double, high double, mean array<double>, m2 array<double>"


def _moments(rows: DataFrame) -> dict[tuple[int, int, int], tuple]:
    """By cell, fold and response what `_merge` merges, of the rows that have the response."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for b in batches:
            if not len(b):
                continue
            cell, fold, w, y, x = _arrays(b)
            for c, k in {*zip(cell.tolist(), fold.tolist(), strict=True)}:
                own = (cell == c) & (fold == k)
                for r in range(y.shape[1]):
                    good = own & ~np.isnan(y[:, r])
                    if not good.any():
                        continue
                    ww, xx, yy = w[good], x[good], y[good, r]
                    n = float(ww.sum())
                    mean = ww @ xx / n
                    part = (n, float(ww @ ww), float(ww @ yy), float(yy.min()), float(yy.max()), mean, ww @ (xx - mean) ** 2)
                    held[c, k, r] = _merge(held[c, k, r], part) if (c, k, r) in held else part
        cells = [(*key, *v[:5], v[5].tolist(), v[6].tolist()) for key, v in held.items()]
        table = list(zip(*cells, strict=True)) if cells else [[]] * 10
        types = [pa.int32()] * 3 + [pa.float64()] * 5 + [pa.list_(pa.float64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, types, strict=True)], [f.split()[0] for f in _MOMENTS.split(", ")])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = [(*r[3:8], np.asarray(r[8]), np.asarray(r[9])) for r in group.itertuples(index=False)]
        total = parts[0]
        for p in parts[1:]:
            total = _merge(total, p)
        return pd.DataFrame([(*group.iloc[0, :3], *total)], columns=group.columns)

    found = rows.mapInArrow(partial, _MOMENTS).groupBy("cell", "fold", "response").applyInPandas(add, _MOMENTS).collect()
    return {(r.cell, r.fold, r.response): (r.n, r.n2, r.sy, r.low, r.high, np.array(r["mean"]), np.array(r["m2"])) for r in found}


def _slopes(family: str, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its first and its second derivative in the linear predictor, of each row."""
    if family == "poisson":
        mu = np.exp(np.minimum(eta, 50.0))
        return mu - y * eta, mu - y, mu
    p = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
    return np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0) - y * eta, p - y, p * (1 - p)


def _penalty(model: Model, w: np.ndarray) -> float:
    return model.penalty * (model.mix * float(np.abs(w[1:]).sum()) + (1 - model.mix) / 2 * float(w[1:] @ w[1:]))


def lasso_step(h: np.ndarray, q: np.ndarray, w: np.ndarray, hard: np.ndarray, soft: np.ndarray, sweeps: int = 5000, within: float = 1e-12) -> np.ndarray:
    """The w with the least w'hw / 2 - q'w + sum(hard * |w|) + sum(soft * w^2) / 2, by coordinates from the w given.

    Columns without curvature stay at 0.
    """
    w = w.copy()
    s = h @ w
    d = np.diag(h) + soft
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(d > 1e-14):
            r = q[j] - s[j] + h[j, j] * w[j]
            new = math.copysign(max(abs(r) - hard[j], 0.0), r) / d[j]
            if new != w[j]:
                s += h[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]) * math.sqrt(d[j]))
                w[j] = new
        if most <= within:
            break
    return w


def _next(model: Model, w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The weights that a proximal Newton step from w leads to."""
    at = np.arange(len(w)) if model.columns is None else np.array([0, *[c + 1 for c in model.columns]])
    out, h, g, old = w.copy(), h[np.ix_(at, at)], g[at], w[at]
    spare = np.r_[0.0, np.ones(len(at) - 1)] * model.penalty
    if model.penalty * model.mix > 0:
        out[at] = lasso_step(h, h @ old - g, old, spare * model.mix, spare * (1 - model.mix))
    else:
        out[at] = old - np.linalg.lstsq(h + np.diag(spare), g + spare * old, rcond=1e-12)[0]
    return out


def _scan(rows: DataFrame, family: str, work: dict[int, tuple]) -> dict[int, tuple[float, np.ndarray]]:
    """By number of a model in `work` (model, weights tried, means, scales, weight of its rows): its objective at these weights
    and the weights to try next."""
    p = len(next(iter(work.values()))[1])
    upper = np.triu_indices(p)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list[int]] = {}
        for i, (m, *_rest) in work.items():
            groups.setdefault((m.cell, m.fold, m.response), []).append(i)
        held: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            cell, fold, w, y, x = _arrays(b)
            for (c, k, r), members in groups.items():
                good = (cell == c) & ~np.isnan(y[:, r])
                if k is not None:
                    good &= (fold != k) & (fold != _NO_FOLD)
                if not good.any():
                    continue
                _, _, mean, scale, _ = work[members[0]]
                z = np.column_stack([np.ones(int(good.sum())), (x[good] - mean) * scale])
                ww, yy = w[good][:, None], y[good, r][:, None]
                loss, first, second = _slopes(family, z @ np.column_stack([work[i][1] for i in members]), yy)
                loss, first, second = (ww * loss).sum(0), z.T @ (ww * first), ww * second
                for at, i in enumerate(members):
                    own = held.setdefault(i, [0.0, np.zeros(p), np.zeros((p, p))])
                    own[0] += float(loss[at])
                    own[1] += first[:, at]
                    own[2] += (z * second[:, at : at + 1]).T @ z
        salt = TaskContext.get().partitionId() // FAN_IN
        for i, (loss, g, h) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([np.r_[loss, g, h[upper]].tolist()], pa.list_(pa.float64()))], ["model", "salt", "s"])

    def total(t: pa.Table) -> np.ndarray:
        return t.column("s").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"model": t.column("model")[:1], "salt": t.column("salt")[:1], "s": pa.array([total(t).tolist()], pa.list_(pa.float64()))})

    def step(t: pa.Table) -> pa.Table:
        i = t.column("model")[0].as_py()
        model, w, _, _, n = work[i]
        s = total(t) / n
        h = np.zeros((p, p))
        h[upper] = s[1 + p :]
        h = h + np.triu(h, 1).T
        return pa.table({"model": pa.array([i], pa.int32()), "objective": [float(s[0]) + _penalty(model, w)], "w": pa.array([_next(model, w, s[1 : 1 + p], h).tolist()], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(partial, "model int, salt int, s array<double>").groupBy("model", "salt").applyInArrow(add, "model int, salt int, s array<double>")
    return {r.model: (r.objective, np.array(r.w)) for r in sums.groupBy("model").applyInArrow(step, "model int, objective double, w array<double>").collect()}


def fit(rows: DataFrame, models: Sequence[Model], family: str = "logistic", within: float = 1e-9, most_passes: int = 60) -> list[Fit]:
    """The models fitted on the rows that `laid` gives, in their order; family logistic (y 0 or 1) or poisson (log link, y >= 0).

    A model is done when its weights move by no more than `within` (in scaled columns); a step that makes its objective worse
    is halved. Columns are scaled by their sample deviation over the training rows; a constant one has weight 0. A logistic
    model without a penalty on classes that a plane separates has no optimum: it ends as not_converged.
    """
    with written(rows) as kept:
        moments, fits, todo = _moments(kept), [], []
        for m in models:
            parts = [v for (c, k, r), v in moments.items() if c == m.cell and r == m.response and (m.fold is None or k not in (m.fold, _NO_FOLD))]
            if not parts:
                fits.append(Fit(m, "no_rows"))
                continue
            n, n2, sy, low, high, mean, m2 = parts[0]
            for part in parts[1:]:
                n, n2, sy, low, high, mean, m2 = _merge((n, n2, sy, low, high, mean, m2), part)
            if low == high and family == "logistic" or high <= 0 and family == "poisson":
                fits.append(Fit(m, "missing_class" if family == "logistic" else "all_zero", n))
                continue
            free = n - n2 / n
            sd = np.sqrt(m2 / free) if free > 0 else np.zeros(len(mean))
            scale = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), 1 / np.where(sd > 0, sd, 1.0), 0.0)
            start = np.zeros(len(mean) + 1)
            start[0] = math.log(sy / n) if family == "poisson" else math.log(sy / (n - sy))
            todo.append([len(fits), m, start, mean, scale, n])
            fits.append(Fit(m, "not_converged", n))
        share = max(1, HELD // (len(todo[0][2]) ** 2)) if todo else 1
        for first in range(0, len(todo), share):
            state = {i: {"try": w, "best": w, "objective": math.inf} for i, _, w, *_ in todo[first : first + share]}
            fixed = {i: (m, mean, scale, n) for i, m, _, mean, scale, n in todo[first : first + share]}
            live, passes = set(state), 0
            while live and passes < most_passes:
                passes += 1
                found = _scan(kept, family, {i: (fixed[i][0], state[i]["try"], *fixed[i][1:]) for i in live})
                for i, (objective, ahead) in found.items():
                    s = state[i]
                    if objective <= s["objective"] + 1e-13 * max(1.0, abs(objective)):
                        moved = float(np.abs(ahead - s["try"]).max())
                        s["best"], s["objective"], s["try"] = s["try"], objective, ahead
                    else:
                        s["try"] = (s["best"] + s["try"]) / 2
                        moved = float(np.abs(s["try"] - s["best"]).max())
                    if moved <= within:
                        live.discard(i)
                        fits[i].status = "ok"
                    fits[i].passes = passes
            for i, s in state.items():
                model, mean, scale, _ = fixed[i]
                w = s["best"][1:] * scale
                fits[i].weights, fits[i].intercept = w.tolist(), float(s["best"][0] - w @ mean)
                fits[i].loss = s["objective"] - _penalty(model, s["best"])
        return fits


def fits_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """The fits as rows: model (place), response, cell, held_out, penalty, mix, n, loss, intercept, weights, passes, status; models
    without weights have null there."""
    none = lambda v: None if math.isnan(v) else float(v)
    cells = [(i, f.model.response, f.model.cell, f.model.fold, float(f.model.penalty), float(f.model.mix), float(f.n), none(f.loss), none(f.intercept), f.weights or None, f.passes, f.status) for i, f in enumerate(fits)]
    return spark.createDataFrame(cells, "model int, response int, cell int, held_out int, penalty double, mix double, n double, loss double, intercept double, weights array<double>, passes int, status string")


def scored(rows: DataFrame, fits: Sequence[Fit], on: Column, x: str = "x") -> DataFrame:
    """rows beside each model that `on` (of columns of rows and of `fits_table`) gives them, with eta, the linear predictor."""
    table = fits_table(rows.sparkSession, fits)
    small = sum(len(f.weights) + 8 for f in fits) <= BROADCAST_WEIGHTS
    out = rows.join(F.broadcast(table) if small else table, on)
    return out.withColumn("eta", F.aggregate(F.zip_with(F.col(x).cast("array<double>"), "weights", lambda a, b: a * b), F.col("intercept"), lambda a, b: a + b))


def violations(rows: DataFrame, fits: Sequence[Fit], family: str, size: int) -> DataFrame:
    """(model, term, violation) of the conditions of an optimum over a model's training rows (cell, fold, y, x of `size`
    elements, all of one weight): the intercept's mean residual (term -1), and for a column how far its slope lies from what
    the penalty allows (0 for a constant column). All are 0 at the optimum; models without weights have no row."""
    on = (F.col("cell") == F.col("_cell")) & (F.col("held_out").isNull() | ((F.col("_fold") != F.col("held_out")) & (F.col("_fold") != _NO_FOLD)))
    own = rows.withColumnsRenamed({"cell": "_cell", "fold": "_fold"})
    each = scored(own, [f for f in fits if f.weights], on).withColumn("_y", F.get("y", "response")).where("_y IS NOT NULL")
    r = (F.exp("eta") if family == "poisson" else 1 / (1 + F.exp(-F.col("eta")))) - F.col("_y")
    each = each.withColumn("_r", r)
    aggs = [a for i in range(size) for a in (F.avg(F.col("_r") * F.get("x", F.lit(i))).alias(f"_g{i}"), F.stddev_samp(F.get("x", F.lit(i))).alias(f"_s{i}"))]
    by = each.groupBy("model").agg(F.first("penalty").alias("penalty"), F.first("mix").alias("mix"), F.first("weights").alias("weights"), F.avg("_r").alias("_g"), *aggs)

    def away(i: int) -> Column:
        b = F.get("weights", F.lit(i)) * F.col(f"_s{i}")
        slope = F.try_divide(F.col(f"_g{i}"), f"_s{i}") + F.col("penalty") * (1 - F.col("mix")) * b
        bound = F.col("penalty") * F.col("mix")
        return F.when(b == 0, F.greatest(F.lit(0.0), F.abs(slope) - bound)).otherwise(F.abs(slope + bound * F.signum(b)))

    terms = [F.struct(F.lit(-1).alias("term"), F.abs("_g").alias("violation")), *[F.struct(F.lit(i).alias("term"), away(i).alias("violation")) for i in range(size)]]
    return by.select("model", F.inline(F.array(*terms)))


def chi_square_tail(x: float, freedom: int) -> float:
    """The chance that a chi-square variable of whole degrees of freedom exceeds x."""
    if x <= 0:
        return 1.0
    even = freedom % 2 == 0
    term, total = (math.exp(-x / 2), 0.0) if even else (math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erfc(math.sqrt(x / 2)))
    for k in range(2 if even else 3, freedom + 1, 2):
        total += term
        term *= x / k
    return min(1.0, total)


def poisson_granger(rows: DataFrame, responses: int, own: Sequence[Sequence[int]], other: Sequence[Sequence[int]], within: float = 1e-8) -> DataFrame:
    """For each response, Poisson models of its counts on its own lags (restricted) and on these and the other side's
    (full): n, both mean losses, statistic = 2 n (restricted - full), degrees of freedom, p from the chi-square tail, gain
    (the mean loss that the other side's lags save), status.

    rows come from `laid`; own and other are the columns of x by response. All models share the scans. A full model that is
    worse than the restricted one by over `within` of the loss has status not_nested, one that has no weights the reason.
    """
    models = [Model(r, None, 0, tuple(c)) for r in range(responses) for c in (own[r], [*own[r], *other[r]])]
    fits, cells = fit(rows, models, "poisson"), []
    for r in range(responses):
        a, b = fits[2 * r], fits[2 * r + 1]
        bad = next((f.status for f in (a, b) if f.status != "ok"), None)
        gain = a.loss - b.loss
        if bad is None and gain < -within * max(1.0, abs(a.loss)):
            bad = "not_nested"
        stat = None if bad else 2 * a.n * max(gain, 0.0)
        cells.append((r, int(a.n), None if bad else a.loss, None if bad else b.loss, stat, len(other[r]), None if bad else chi_square_tail(stat, len(other[r])), None if bad else max(gain, 0.0), bad or "ok"))
    return rows.sparkSession.createDataFrame(cells, "response int, n long, restricted double, full double, statistic double, freedom int, p double, gain double, status string")
