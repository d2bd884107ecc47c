"""Linear models from one pass of cross products: regression, held-out scores, Granger, principal and canonical components.

Rows are reduced to sums of products on Spark; what reaches the driver is (folds x (p + 1)^2) numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.batched import lasso_step


def gram(rows: DataFrame, vector: str, fold: str | None = None) -> dict[int, np.ndarray]:
    """By fold, the sums of products of (1, x) with itself. Vectors that are null or hold null or non-finite values take no part.

    All vectors have one length. Each task adds up its batches; the partial sums are added by shuffle, cell by cell.
    """
    data = rows.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), F.col(vector).cast("array<double>").alias("x")).where("fold IS NOT NULL AND x IS NOT NULL")
    data = data.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            at, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(len(b), -1)
            z = np.column_stack([np.ones(len(x)), x])
            for k in np.unique(at):
                part = z[at == k]
                held[int(k)] = held.get(int(k), 0) + part.T @ part
        for k, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([g.ravel().tolist()])], ["fold", "g"])

    cells = data.mapInArrow(partial, "fold int, g array<double>").select("fold", F.posexplode("g").alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v"))
    out: dict[int, list] = {}
    for r in cells.orderBy("fold", "at").collect():
        out.setdefault(r["fold"], []).append(r["v"])
    return {k: np.array(v).reshape(int(len(v) ** 0.5), -1) for k, v in out.items()}


def solve(g: np.ndarray, x: list[int], y: list[int], alpha: float = 0.0) -> np.ndarray:
    """Coefficients (1 + len(x), len(y)) of y on x from cross products; places count from 0. The penalty spares the
    intercept and is n * alpha on centred x; without one the solution has the least norm."""
    n, xs, ys = g[0, 0], [i + 1 for i in x], [i + 1 for i in y]
    mx, my = g[0, xs] / n, g[0, ys] / n
    a = g[np.ix_(xs, xs)] - n * np.outer(mx, mx) + n * alpha * np.eye(len(xs))
    b = g[np.ix_(xs, ys)] - n * np.outer(mx, my)
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return np.vstack([my - mx @ beta, beta])


def squared_errors(g: np.ndarray, coef: np.ndarray, x: list[int], y: list[int]) -> np.ndarray:
    """Sums of squared errors of predictions on the rows behind g."""
    xs, ys = [0, *[i + 1 for i in x]], [i + 1 for i in y]
    return np.diag(g[np.ix_(ys, ys)]) - 2 * np.einsum("ij,ij->j", coef, g[np.ix_(xs, ys)]) + np.einsum("ij,ik,kj->j", coef, g[np.ix_(xs, xs)], coef)


def elastic_path(g: np.ndarray, x: list[int], y: int, penalties: Sequence[float], mix: float) -> list[np.ndarray]:
    """Weights (intercept first, scale of the rows) of y on x by penalty, from cross products by coordinate descent with
    covariance updates, each from the penalty before. The loss is half the mean square; the penalty is on columns scaled by
    their deviation over n, mix its absolute part; a constant column has weight 0."""
    n, xs = g[0, 0], [i + 1 for i in x]
    mx, my = g[0, xs] / n, g[0, y + 1] / n
    var = np.diag(g)[xs] / n - mx * mx
    scale = np.where(var > 1e-12 * np.maximum(1.0, mx * mx), 1 / np.sqrt(np.maximum(var, 1e-300)), 0.0)
    h = (g[np.ix_(xs, xs)] / n - np.outer(mx, mx)) * np.outer(scale, scale)
    q = (g[xs, y + 1] / n - mx * my) * scale
    w, ones, out = np.zeros(len(x)), np.ones(len(x)), []
    for p in penalties:
        w = lasso_step(h, q, w, ones * p * mix, ones * p * (1 - mix))
        b = w * scale
        out.append(np.r_[my - mx @ b, b])
    return out


def ridge(rows: DataFrame, vector: str, x: list[int], y: list[int], alpha: float = 0.0) -> DataFrame:
    """(response, term, coefficient); term -1 is the intercept. No rows give no coefficients."""
    g = gram(rows, vector).get(0)
    coef = np.zeros((0, 0)) if g is None else solve(g, x, y, alpha)
    cells = [(j, i, float(c)) for row, i in zip(coef, [-1, *x], strict=False) for c, j in zip(row, y, strict=True)]
    return rows.sparkSession.createDataFrame(cells, "response int, term int, coefficient double")


def block_cv(rows: DataFrame, vector: str, fold: str, x: list[int], y: list[int], alpha: float = 0.0) -> DataFrame:
    """(fold, response, n, mse, r2) of each fold from the model of the others: the total's products less the fold's.

    r2 is against the fold's own mean; null where the response does not vary or another fold is missing.
    """
    by = gram(rows, vector, fold)
    total, out = sum(by.values()), []
    for k, g in by.items():
        n = g[0, 0]
        error = squared_errors(g, solve(total - g, x, y, alpha), x, y) if len(by) > 1 else np.full(len(y), np.nan)
        for e, j in zip(error, y, strict=True):
            spread = g[j + 1, j + 1] - g[0, j + 1] ** 2 / n
            out.append((k, j, int(n), None if np.isnan(e) else float(e / n), None if np.isnan(e) or spread <= 1e-12 * max(1.0, g[j + 1, j + 1]) else float(1 - e / spread)))
    return rows.sparkSession.createDataFrame(out, "fold int, response int, n long, mse double, r2 double")


def granger(rows: DataFrame, vector: str, y: int, own: list[int], other: list[int], tolerance: float = 1e-9) -> DataFrame:
    """Sums of squares of y on its own lags and on both, and log(restricted / full); a negative value within the tolerance is 0."""
    g, out = gram(rows, vector).get(0), []
    if g is not None:
        r, f = (float(squared_errors(g, solve(g, x, [y]), x, [y])[0]) for x in (own, own + other))
        value = float(np.log(r / f)) if r > 0 and f > 0 else None
        out.append((int(g[0, 0]), r, f, 0.0 if value is not None and -tolerance <= value < 0 else value))
    return rows.sparkSession.createDataFrame(out, "n long, sse_restricted double, sse_full double, granger double")


def _scaled(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of the columns that vary, and their places."""
    n, m = g[0, 0], g[0, 1:] / g[0, 0]
    c = g[1:, 1:] / n - np.outer(m, m)
    keep = np.flatnonzero(np.diag(c) > 1e-12 * np.maximum(1.0, m * m))
    sd = np.sqrt(np.diag(c)[keep])
    return c[np.ix_(keep, keep)] / np.outer(sd, sd), keep


def pca(rows: DataFrame, vector: str) -> DataFrame:
    """(component from 1, ratio, cumulative, loadings) of the scaled columns; the largest loading is positive, constant columns load 0."""
    g, out = gram(rows, vector).get(0), []
    if g is not None:
        c, keep = _scaled(g)
        values, vectors = np.linalg.eigh(c)
        order = np.argsort(-values)
        share = np.maximum(values[order], 0) / max(len(keep), 1)
        for k, i in enumerate(order):
            v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
            full = np.zeros(len(g) - 1)
            full[keep] = v
            out.append((k + 1, float(share[k]), float(share[: k + 1].sum()), full.tolist()))
    return rows.sparkSession.createDataFrame(out, "component int, ratio double, cumulative double, loadings array<double>")


def cca(rows: DataFrame, vector: str, a: list[int], b: list[int], rcond: float = 1e-9) -> DataFrame:
    """(component from 1, correlation) of two sets of scaled columns, largest first; directions of no variance are left out."""
    g, out = gram(rows, vector).get(0), []
    if g is not None:
        c, keep = _scaled(g)
        place = {int(k): i for i, k in enumerate(keep)}
        pa_, pb = ([place[i] for i in side if i in place] for side in (a, b))

        def whiten(side: list[int]) -> np.ndarray:
            values, vectors = np.linalg.eigh(c[np.ix_(side, side)])
            good = values > rcond * max(values.max(initial=0), 1)
            return vectors[:, good] / np.sqrt(values[good])

        if pa_ and pb:
            found = np.linalg.svd(whiten(pa_).T @ c[np.ix_(pa_, pb)] @ whiten(pb), compute_uv=False)
            out = [(i + 1, float(min(1.0, s))) for i, s in enumerate(found)]
    return rows.sparkSession.createDataFrame(out, "component int, correlation double")


def cca_axes(rows: DataFrame, vector: str, a: list[int], b: list[int], rcond: float = 1e-9) -> DataFrame:
    """(component from 1, correlation, a, b, a0, b0) with the axes as weights on the unscaled elements of either set, so
    that a0 + sum(a * x) has mean 0 and variance 1. The largest weight of a (on scaled elements) is positive, and b has the
    sign that pairs with it; constant elements weigh 0. No rows or a set without variance give no axes."""
    g, out = gram(rows, vector).get(0), []
    if g is not None:
        c, keep = _scaled(g)
        n, place = g[0, 0], {int(k): i for i, k in enumerate(keep)}
        mean = g[0, 1:] / n
        sd = np.sqrt(np.maximum(np.diag(g)[1:] / n - mean * mean, 0))
        used = [[i for i in side if i in place] for side in (a, b)]

        def whiten(side: list[int]) -> np.ndarray:
            at = [place[i] for i in side]
            values, vectors = np.linalg.eigh(c[np.ix_(at, at)])
            good = values > rcond * max(values.max(initial=0), 1)
            return vectors[:, good] / np.sqrt(values[good])

        if all(used):
            wa, wb = whiten(used[0]), whiten(used[1])
            u, r, vt = np.linalg.svd(wa.T @ c[np.ix_([place[i] for i in used[0]], [place[i] for i in used[1]])] @ wb, full_matrices=False)
            axes = wa @ u, wb @ vt.T
            for k, value in enumerate(r):
                sign = np.sign(axes[0][np.argmax(np.abs(axes[0][:, k])), k])
                full = []
                for side, own, w in zip((a, b), used, axes, strict=True):
                    weight = dict(zip(own, sign * w[:, k] / sd[own], strict=True))
                    full.append([float(weight.get(i, 0.0)) for i in side])
                offsets = [-float(np.dot(w, mean[side])) for w, side in zip(full, (a, b), strict=True)]
                out.append((k + 1, float(min(1.0, value)), *full, *offsets))
    return rows.sparkSession.createDataFrame(out, "component int, correlation double, a array<double>, b array<double>, a0 double, b0 double")


def cca_transform(rows: DataFrame, axes: DataFrame, vector: str, a: list[int], b: list[int]) -> DataFrame:
    """Rows with u and v, arrays of their scores on all axes (as `cca_axes` gives them) of either set."""
    found = axes.orderBy("component").collect()

    def scores(side: list[int], name: str) -> Column:
        own = F.transform(F.lit(side), lambda i: F.get(F.col(vector), i).cast("double"))
        return F.array(*[F.aggregate(F.zip_with(own, F.lit(r[name]), lambda x, w: x * w), F.lit(r[name + "0"]), lambda s, t: s + t) for r in found])

    return rows.withColumn("u", scores(a, "a")).withColumn("v", scores(b, "b"))
