"""Decoders and regressions with held-out folds: batched steps where there is an iteration, cross products where there is none.

Rows have a fold, a label or response, and a vector (array<double>); vectors of one call have one length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.batched import Model, fit, fits_table, laid, scored as beside
from weftline.operators.linear import elastic_path, gram, solve, squared_errors
from weftline.operators.ranks import numbered
from weftline.sources.scratch import shared_folder, written

#: The fixed order of candidates (penalty, share of it that is absolute), weakest first.
GRID = tuple((p, e) for p in (0.001, 0.01, 0.1, 1.0, 10.0) for e in (0.0, 0.5, 1.0))


def _points(rows: DataFrame, vector: str = "x") -> DataFrame:
    """rows with the vector as Spark ML takes it, checkpointed: each fit reads them many times."""
    shared_folder(rows.sparkSession)
    return rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))).checkpoint()


def _folds(rows: DataFrame, fold: str) -> list[int]:
    """The folds of rows: each is a model."""
    return sorted(r[0] for r in rows.select(fold).where(F.col(fold).isNotNull()).distinct().collect())


def _logistic(penalty: float, mix: float, weight: str | None) -> LogisticRegression:
    model = LogisticRegression(featuresCol="_v", labelCol="label", regParam=penalty, elasticNetParam=mix, maxIter=60, standardization=True)
    return model.setWeightCol(weight) if weight else model


def _binary(rows: DataFrame) -> DataFrame:
    """Rows with label and vector, the label as a number."""
    return rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).withColumn("label", F.col("label").cast("double"))


def _chance(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def decode(rows: DataFrame, fold: str = "fold", penalty: float = 0.01, mix: float = 0.0, weight: str | None = None) -> DataFrame:
    """Rows (label 0/1, x, fold) with p, the chance of label 1 from the model fitted without the row's fold, and reason.

    A fold whose training rows lack a class is not predicted: p is null and reason missing_class (no_rows if there are none).
    Rows with null label or vector are no part. `weight` is a column, such as 1 / (bins of the trial) for pooled bins. All
    folds are fitted by the same scans.
    """
    data = _binary(rows).where(F.col(fold).isNotNull())
    fits = fit(laid(data, F.array("label"), fold=fold, weight=weight), [Model(fold=k, penalty=penalty, mix=mix) for k in _folds(data, fold)])
    table = fits_table(rows.sparkSession, fits).select(F.col("held_out").alias("_k"), F.col("intercept").alias("_b"), F.col("weights").alias("_w"), F.col("status").alias("_s"))
    eta = F.aggregate(F.zip_with(F.col("x").cast("array<double>"), "_w", lambda a, b: a * b), F.col("_b"), lambda a, b: a + b)
    out = data.join(F.broadcast(table), F.col(fold) == F.col("_k"))
    return out.select(*[F.col(c) for c in data.columns if c not in ("p", "reason")], _chance(eta).alias("p"), F.when(F.col("_w").isNull(), F.col("_s")).alias("reason"))


def tuned(rows: DataFrame, fold: str = "fold", grid: Sequence[tuple[float, float]] = GRID, cell: str | None = None, weight: str | None = None) -> DataFrame:
    """Mean held-out accuracy of each candidate in the grid's order, and which is chosen: the first with the strictly
    highest mean over folds that all have a score. With `cell`, such as a time bin, a choice for each of its values.

    The models of all cells, folds and candidates are fitted by the same scans; one more scores them.
    """
    data = _binary(rows).where(F.col(fold).isNotNull())
    data = data.withColumn("_cell", F.col(cell).cast("int") if cell else F.lit(0)).where("_cell IS NOT NULL")
    parts = sorted((r[0], r[1]) for r in data.select("_cell", F.col(fold).cast("int")).distinct().collect())
    models = [Model(0, k, c, None, p, e) for c, k in parts for p, e in grid]
    fits = fit(laid(data, F.array("label"), fold=fold, cell="_cell", weight=weight), models)
    on = (F.col("_cell") == F.col("cell")) & (F.col("_fold") == F.col("held_out"))
    each = beside(data.select("_cell", F.col(fold).alias("_fold"), "label", "x"), fits, on).withColumn("candidate", F.pmod("model", F.lit(len(grid))))
    hit = ((F.col("eta") >= 0).cast("double") == F.col("label")).cast("double")
    by = each.groupBy("cell", "candidate", "held_out").agg(F.when(F.count_if(F.col("eta").isNull()) == 0, F.avg(hit)).alias("a"))
    by = by.groupBy("cell", "candidate").agg(F.when(F.count_if(F.col("a").isNull()) == 0, F.avg("a")).alias("score"))
    by = by.join(F.broadcast(rows.sparkSession.createDataFrame([(i, float(p), float(e)) for i, (p, e) in enumerate(grid)], "candidate int, penalty double, mix double")), "candidate")
    best = F.max_by("candidate", F.when(F.col("score").isNotNull(), F.struct("score", -F.col("candidate")))).over(Window.partitionBy("cell"))
    out = by.select("cell", "candidate", "penalty", "mix", "score", F.coalesce(F.col("candidate") == best, F.lit(False)).alias("chosen")).orderBy("cell", "candidate")
    return out.withColumnRenamed("cell", cell) if cell else out.drop("cell")


def label_draws(rows: DataFrame, draws: Sequence[int], row_id: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows with ys, the row's own label and then, for each draw, that of another row, by an order from a hash of id and
    draw; the counts of labels stay. `within` keeps labels in their group. row_id is unique.

    Places are joined with places, so that no label passes through the driver and all rows through no one task; all draws go
    through one sort.
    """
    keys = ["_all", *within]
    have = numbered(rows.select(F.lit(0).alias("_all"), *within, row_id), keys, [row_id], "_r")
    give = rows.select(F.explode(F.lit(list(draws))).alias("_draw"), *within, F.col(row_id).alias("_id"), "label")
    give = give.withColumn("_all", F.lit(0)).withColumn("_o", F.xxhash64("_id", "_draw"))
    give = numbered(give, ["_draw", *keys], ["_o", "_id"], "_r")
    met = have.join(give, [*keys, "_r"]).groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("_draw", "label"))).alias("_l"))
    return rows.join(met, row_id).withColumn("ys", F.concat(F.array("label"), F.transform("_l", lambda v: v["label"]))).drop("_l")


def shuffled_labels(rows: DataFrame, draw: int, row_id: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows whose labels are those of one draw of `label_draws`."""
    return label_draws(rows, [draw], row_id, within).withColumn("label", F.get("ys", F.lit(1))).drop("ys")


def decodability(rows: DataFrame, row_id: str, draws: int = 20, fold: str = "fold", penalty: float = 0.01, mix: float = 0.5, least: int = 10) -> DataFrame:
    """N, held-out accuracy, mean accuracy under shuffled labels, p = (1 + shuffles at or over it) / (1 + shuffles), and
    reason: no_valid_samples, insufficient_classes or insufficient_samples (a class under `least` rows).

    All draws and folds are fitted by the same scans. A draw whose training rows lack a class has no score.
    """
    good = _binary(rows)
    n = {r["label"]: r["count"] for r in good.groupBy("label").count().collect()}
    reason = "no_valid_samples" if not n else "insufficient_classes" if len(n) < 2 else "insufficient_samples" if min(n.values()) < least else None
    own, null = None, []
    if reason is None:
        with written(label_draws(good.where(F.col(fold).isNotNull()).select(row_id, F.col(fold).alias("_fold"), "label", "x"), range(1, draws + 1), row_id)) as drawn:
            fits = fit(laid(drawn, F.col("ys"), fold="_fold"), [Model(r, k, 0, None, penalty, mix) for r in range(draws + 1) for k in _folds(drawn, "_fold")])
            each = beside(drawn, fits, F.col("_fold") == F.col("held_out"))
            hit = ((F.col("eta") >= 0).cast("double") == F.get("ys", "response")).cast("double")
            found = {r["response"]: r["a"] for r in each.groupBy("response").agg(F.avg(F.when(F.col("eta").isNotNull(), hit)).alias("a")).collect()}
        own, null = found.get(0), [a for r, a in found.items() if r > 0 and a is not None]
    p = (1 + sum(x >= own for x in null)) / (1 + len(null)) if own is not None and null else None
    cells = [(sum(n.values()), own, float(np.mean(null)) if null else None, p, reason)]
    return rows.sparkSession.createDataFrame(cells, "n long, accuracy double, null_accuracy double, p double, reason string")


def transfer(rows: DataFrame, source: Column, target: Column, row_id: str, penalty: float = 0.01) -> DataFrame:
    """A model fitted on the source rows, classes weighing the same, scores both sides: row id, label, p and role
    (train, test). The two conditions share no row: a row of both is training only. A missing class gives null scores."""
    good = _points(rows.where(F.col("label").isNotNull() & F.col("x").isNotNull())).withColumn("label", F.col("label").cast("double"))
    good = good.withColumn("role", F.when(source, "train").when(target, "test")).where("role IS NOT NULL")
    n = {r["label"]: r["count"] for r in good.where("role = 'train'").groupBy("label").count().collect()}
    if len(n) < 2:
        return good.select(row_id, "label", "role", F.lit(None).cast("double").alias("p"))
    weigh = F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0]))
    model = _logistic(penalty, 0.0, "_w").fit(good.where("role = 'train'").withColumn("_w", weigh))
    return model.transform(good).select(row_id, "label", "role", vector_to_array("probability")[1].alias("p"))


def readouts(rows: DataFrame, windows: DataFrame, fold: str = "fold", penalty: float = 0.01) -> DataFrame:
    """Each fold's readout, fitted on the other folds' rows, predicts that fold's windows (window, fold, x) alone:
    window, fold, p, and contributions, the elements of x times their weights. Folds without a readout have null and a reason."""
    fits = fit(laid(_binary(rows), F.array("label"), fold=fold), [Model(fold=k, penalty=penalty) for k in _folds(windows, fold)])
    table = fits_table(rows.sparkSession, [f for f in fits if f.weights]).select(F.col("held_out").alias("_k"), "intercept", "weights")
    out = windows.join(F.broadcast(table), F.col(fold) == F.col("_k"), "left").withColumn("contributions", F.zip_with("x", "weights", lambda a, b: a * b))
    z = F.aggregate("contributions", F.col("intercept"), lambda a, b: a + b)
    return out.select("window", fold, _chance(z).alias("p"), "contributions", F.when(F.col("weights").isNull(), "no_readout").alias("reason"))


def dichotomies(conditions: Sequence[str]) -> list[tuple[str, ...]]:
    """The positive side of every way to split the conditions in two, each way once, the first condition positive."""
    first, rest = conditions[0], conditions[1:]
    return [(first, *c) for k in range(len(rest)) for c in combinations(rest, k)]


def shattering(rows: DataFrame, conditions: Sequence[str], row_id: str, condition: str = "condition", share: float = 0.2) -> DataFrame:
    """Held-out accuracy of a linear SVM for each dichotomy of the conditions (few: each is a model); rows are held out by a hash of their id."""
    points = _points(rows.where(F.col(condition).isin(list(conditions)) & F.col("x").isNotNull()))
    points = points.withColumn("_out", F.pmod(F.xxhash64(F.col(row_id), F.lit(5)), F.lit(1000)) < int(1000 * share))
    cells = []
    for side in dichotomies(conditions):
        own = points.withColumn("label", F.col(condition).isin(list(side)).cast("double"))
        model = LinearSVC(featuresCol="_v", labelCol="label", regParam=0.01, maxIter=40).fit(own.where("NOT _out"))
        a = model.transform(own.where("_out")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
        cells.append((",".join(side), a["n"], a["a"]))
    return rows.sparkSession.createDataFrame(cells, "positive string, n long, accuracy double")


def tree_importance(rows: DataFrame, names: Sequence[str], label: str, trees: int = 50, seed: int = 17) -> DataFrame:
    """Importance of each predictor column in a random forest; rows with a null are no part."""
    data = rows.select(F.col(label).cast("double").alias("label"), F.array(*[F.col(n).cast("double") for n in names]).alias("x")).na.drop().where(~F.exists("x", lambda v: v.isNull()))
    m = RandomForestClassifier(featuresCol="_v", labelCol="label", numTrees=trees, seed=seed).fit(_points(data))
    return rows.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, m.featureImportances.toArray(), strict=True)], "predictor string, importance double")


def poisson(rows: DataFrame, fold: str = "fold", penalty: float = 0.0) -> DataFrame:
    """(fold, n, deviance, null_deviance, explained, mse) of a log-link Poisson model of y on x fitted without the fold.

    deviance = 2 sum(y ln(y / mu) - (y - mu)), the first term 0 where y is; the null model is the mean of the fold's own
    y; explained is null where its deviance is 0. A fold without a model (no other rows, or their y all 0) has null figures.
    All folds are fitted by the same scans; the penalty is on squared weights of scaled columns.
    """
    data = rows.where(F.col("y").isNotNull() & F.col("x").isNotNull() & F.col(fold).isNotNull()).withColumn("y", F.col("y").cast("double"))
    fits = fit(laid(data, F.array("y"), fold=fold), [Model(fold=k, penalty=penalty) for k in _folds(data, fold)], "poisson")
    means = data.groupBy(fold).agg(F.avg("y").alias("_mean"))
    out = beside(data.select(fold, "y", "x"), fits, F.col(fold) == F.col("held_out")).select(fold, "y", F.exp("eta").alias("mu")).join(means, fold)
    dev = lambda mu: 2 * (F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / mu)).otherwise(0.0) - (F.col("y") - mu))
    rows = out.groupBy(fold).agg(F.count("*").alias("n"), F.sum(dev(F.col("mu"))).alias("deviance"), F.sum(F.when(F.col("_mean") > 0, dev(F.col("_mean"))).otherwise(0.0)).alias("null_deviance"), F.avg((F.col("y") - F.col("mu")) ** 2).alias("mse"))
    return rows.withColumn("explained", F.when(F.col("null_deviance") > 1e-12, 1 - F.col("deviance") / F.col("null_deviance")))


def penalised_paths(rows: DataFrame, fold: str = "fold", mix: float = 1.0, penalties: Sequence[float] = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003)) -> DataFrame:
    """Held-out mean square by penalty over folds, its standard error (null for one fold), and which penalty is the best
    (least; of equals the larger) and which the 1-SE pick: the largest whose mean is within a standard error of the least.
    mix: 0 ridge, 1 lasso. Fewer than two folds give no row.

    One pass of cross products by fold serves all folds and penalties: a training set is the total less the fold.
    """
    p, by = _joined_gram(rows, fold)
    total, cells = sum(by.values()), []
    if len(by) > 1:
        x, y, order = list(range(p)), p, sorted(penalties, reverse=True)
        paths = {k: elastic_path(total - g, x, y, order, mix) for k, g in by.items()}
        for i, penalty in enumerate(order):
            mse = [float(squared_errors(g, paths[k][i][:, None], x, [y])[0]) / g[0, 0] for k, g in by.items()]
            cells.append((float(penalty), float(np.mean(mse)), float(np.std(mse, ddof=1) / math.sqrt(len(mse)))))
        best = min(cells, key=lambda c: (c[1], -c[0]))
        pick = max(c[0] for c in cells if c[1] <= best[1] + best[2])
        cells = [(*c, c[0] == best[0], c[0] == pick) for c in cells]
    return rows.sparkSession.createDataFrame(cells, "penalty double, mse double, se double, best boolean, one_se boolean")


def _joined_gram(rows: DataFrame, fold: str | None) -> tuple[int, dict[int, np.ndarray]]:
    """How many elements x has, and the cross products of (1, x, y) by fold."""
    good = rows.where(F.col("y").isNotNull() & F.col("x").isNotNull())
    by = gram(good.withColumn("_xy", F.concat(F.col("x").cast("array<double>"), F.array(F.col("y").cast("double")))), "_xy", fold)
    return (len(next(iter(by.values()))) - 2 if by else 0), by


def penalised_weights(rows: DataFrame, penalties: Sequence[float], mix: float = 1.0) -> DataFrame:
    """(penalty, term, coefficient) of y on x over all rows, term -1 the intercept, in the scale of x; one pass for all penalties."""
    p, by = _joined_gram(rows, None)
    order = sorted(penalties, reverse=True)
    path = elastic_path(by[0], list(range(p)), p, order, mix) if by else []
    cells = [(float(l), t - 1, float(v)) for l, w in zip(order, path, strict=False) for t, v in enumerate(w)]
    return rows.sparkSession.createDataFrame(cells, "penalty double, term int, coefficient double")


def penalised_violations(rows: DataFrame, weights: DataFrame, size: int, mix: float = 1.0) -> DataFrame:
    """(penalty, term, violation) of the conditions of the optimum on the rows behind `weights`: the mean residual for the
    intercept, and for a column how far its covariance with the residual lies from what the penalty allows; all 0 there."""
    held: dict[float, dict[int, float]] = {}
    for c in weights.collect():
        held.setdefault(c["penalty"], {})[c["term"]] = c["coefficient"]
    models = [F.struct(F.lit(p).alias("penalty"), F.lit(w[-1]).alias("_b"), F.lit([w[i] for i in range(size)]).alias("_w")) for p, w in held.items()]
    each = rows.where("y IS NOT NULL AND x IS NOT NULL").select("x", "y", F.inline(F.array(*models)))
    r = F.col("y") - F.aggregate(F.zip_with(F.col("x").cast("array<double>"), "_w", lambda a, b: a * b), F.col("_b"), lambda a, b: a + b)
    each = each.withColumn("_r", r)
    aggs = [a for i in range(size) for a in (F.avg(F.col("_r") * F.get("x", F.lit(i))).alias(f"_g{i}"), F.stddev_pop(F.get("x", F.lit(i))).alias(f"_s{i}"))]
    by = each.groupBy("penalty").agg(F.first("_w").alias("_w"), F.avg("_r").alias("_g"), *aggs)

    def away(i: int) -> Column:
        b = F.get("_w", F.lit(i)) * F.col(f"_s{i}")
        slope = F.try_divide(F.col(f"_g{i}"), f"_s{i}") - F.col("penalty") * (1 - mix) * b
        return F.when(b == 0, F.greatest(F.lit(0.0), F.abs(slope) - F.col("penalty") * mix)).otherwise(F.abs(slope - F.col("penalty") * mix * F.signum(b)))

    terms = [F.struct(F.lit(-1).alias("term"), F.abs("_g").alias("violation")), *[F.struct(F.lit(i).alias("term"), away(i).alias("violation")) for i in range(size)]]
    return by.select("penalty", F.inline(F.array(*terms)))


def side_design(blocks: DataFrame, interaction: bool = True) -> DataFrame:
    """Y (trials_to_correct) and x: the preceding rewards, 1 for left, and their product; rows without them are no part."""
    left = (F.col("state") == 1).cast("double")
    terms = [F.col("prev_n_rewarded").cast("double"), left] + ([F.col("prev_n_rewarded") * left] if interaction else [])
    return blocks.where("trials_to_correct IS NOT NULL AND block_run > 1").withColumn("y", F.col("trials_to_correct").cast("double")).withColumn("x", F.array(*terms))


def residuals(rows: DataFrame, penalty: float, mix: float = 1.0) -> DataFrame:
    """Adds predicted and residual of y from the model of x fitted on all rows with both; null where there is no model."""
    p, by = _joined_gram(rows, None)
    w = elastic_path(by[0], list(range(p)), p, [penalty], mix)[0].tolist() if by else []
    terms = F.zip_with(F.col("x").cast("array<double>"), F.array(*map(F.lit, w[1:])), lambda a, b: a * b)
    value = F.aggregate(terms, F.lit(w[0]), lambda a, b: a + b) if w else F.lit(None).cast("double")
    return rows.withColumn("predicted", value).withColumn("residual", F.col("y") - F.col("predicted"))


def predict(rows: DataFrame, coefficients: DataFrame, vector: str, key: str) -> DataFrame:
    """Predictions (key, response, value) of each row from coefficients (response, term, coefficient; term -1 is the intercept)."""
    w = coefficients.groupBy("response").agg(F.map_from_entries(F.collect_list(F.struct("term", "coefficient"))).alias("_w"))
    each = rows.select(key, F.col(vector).cast("array<double>").alias("_x")).join(F.broadcast(w))
    terms = F.transform(F.map_entries("_w"), lambda e: e["value"] * F.when(e["key"] < 0, 1.0).otherwise(F.get("_x", F.greatest(e["key"], F.lit(0)))))
    return each.select(key, "response", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b).alias("value"))


def normal_equations(rows: DataFrame, coefficients: DataFrame, vector: str, x: Sequence[int], y: Sequence[int], key: str) -> DataFrame:
    """For each response the sum of residuals times every predictor (term; -1 for the intercept) over n: all 0 at least squares."""
    p = predict(rows, coefficients, vector, key).join(rows.select(key, F.col(vector).cast("array<double>").alias("_x")), key)
    p = p.withColumn("_r", F.get("_x", F.col("response")) - F.col("value"))
    each = F.array(F.struct(F.lit(-1).alias("term"), F.col("_r").alias("v")), *[F.struct(F.lit(i).alias("term"), (F.col("_r") * F.get("_x", F.lit(i))).alias("v")) for i in x])
    return p.where(F.col("response").isin(list(y))).select("response", F.inline(each)).groupBy("response", "term").agg(F.avg("v").alias("moment"))


def standardise(rows: DataFrame, scaling: DataFrame, vector: str, key: str) -> DataFrame:
    """M01 applied: each element of x, by unit from 1, less its mean and over its deviation; units without a scale (constant) go."""
    at = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("_p", "_x")).withColumn("unit", F.col("_p") + 1)
    return at.join(scaling, "unit").select(key, "unit", ((F.col("_x") - F.col("mean")) / F.col("sd")).alias("z"))


def component_scores(z: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Scores (key, component, score) of standardised rows (key, unit, z) on components (component, loadings)."""
    w = components.select("component", F.posexplode("loadings").alias("_p", "_w")).withColumn("unit", F.col("_p") + 1)
    return z.join(F.broadcast(w), "unit").groupBy(key, "component").agg(F.sum(F.col("z") * F.col("_w")).alias("score"))


def components_to_reach(components: DataFrame, shares: Sequence[float] = (0.8, 0.9, 0.95)) -> DataFrame:
    """How many leading components (component, cumulative) reach each share of the variance; null where all do not."""
    each = components.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return each.groupBy("share").agg(F.min(F.when(F.col("cumulative") >= F.col("share") - 1e-12, F.col("component"))).alias("n_components"))


def window_variance(scores: DataFrame, keys: Sequence[str], share: float = 0.8) -> DataFrame:
    """By window (keys) and component: sample variance of its scores, fraction of the window's variance, rank by it,
    running fraction, components to reach `share`, and status: too_few_rows (under two), no_variance or ok."""
    v = scores.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.var_samp("score").alias("variance"))
    whole = Window.partitionBy(*keys)
    v = v.withColumn("fraction", F.try_divide("variance", F.sum("variance").over(whole)))
    order = whole.orderBy(F.col("variance").desc_nulls_last(), "component")
    v = v.withColumn("place", F.row_number().over(order)).withColumn("cumulative", F.sum("fraction").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    v = v.withColumn("n_to_share", F.min(F.when(F.col("cumulative") >= share - 1e-12, F.col("place"))).over(whole))
    total = F.sum("variance").over(whole)
    return v.withColumn("status", F.when(F.max("n").over(whole) < 2, "too_few_rows").when(F.coalesce(total, F.lit(0.0)) <= 0, "no_variance").otherwise("ok"))


def _rank_errors(train: np.ndarray, test: np.ndarray, x: list[int], y: list[int], alpha: float) -> np.ndarray:
    """Squared error on the cross products `test`, over all responses, of the ridge fit on `train` at each rank from 1."""
    xs, ys = [i + 1 for i in x], [i + 1 for i in y]
    at, m, mx, my = [0, *xs], train[0, 0], train[0, xs] / train[0, 0], train[0, ys] / train[0, 0]
    full = solve(train, x, y, alpha)[1:]
    low = np.linalg.cholesky(train[np.ix_(xs, xs)] - m * np.outer(mx, mx) + m * alpha * np.eye(len(x)))
    v = np.linalg.svd(np.linalg.solve(low, train[np.ix_(xs, ys)] - m * np.outer(mx, my)), full_matrices=False)[2]
    out = []
    for k in range(min(len(x), len(y))):
        b = full @ v[: k + 1].T @ v[: k + 1]
        c = np.vstack([my - mx @ b, b])
        out.append(float(np.trace(test[np.ix_(ys, ys)]) - 2 * np.sum(c * test[np.ix_(at, ys)]) + np.sum(c * (test[np.ix_(at, at)] @ c))))
    return np.array(out)


def nested_rank(rows: DataFrame, vector: str, fold: str, x: list[int], y: list[int], alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0), within: float = 1e-12) -> DataFrame:
    """Held-out R2 by direction, fold (null: all folds together) and rank, with the penalty that the other folds chose.

    For each outer fold the penalty is the largest within `within` of the best full-rank R2 over inner folds, of those left;
    the outer fold takes no part in it. Both directions, x to y and y to x, and all folds use one pass of cross products:
    a training set is the sum less one or two folds. With fewer than three folds there is no inner choice and no row.
    """
    by = gram(rows, vector, fold)
    total, cells = sum(by.values()), []
    spread = lambda g, at: float(np.trace(g[np.ix_(at, at)]) - (g[0, at] ** 2).sum() / g[0, 0])
    for direction, a, b in (("forward", x, y), ("backward", y, x)):
        ys, summed, whole = [i + 1 for i in b], 0.0, 0.0
        for outer, g in by.items() if len(by) > 2 else ():
            rest = {i: h for i, h in by.items() if i != outer}
            base = sum(spread(h, ys) for h in rest.values())
            inner = [1 - sum(_rank_errors(total - g - h, h, a, b, alpha)[-1] for h in rest.values()) / base if base > 0 else math.nan for alpha in alphas]
            alpha = max((p for p, r in zip(alphas, inner, strict=True) if r >= np.nanmax(inner) - within), default=max(alphas))
            error, own = _rank_errors(total - g, g, a, b, alpha), spread(g, ys)
            summed, whole = summed + error, whole + own
            cells += [(direction, int(outer), float(alpha), k + 1, 1 - e / own if own > 0 else None) for k, e in enumerate(error.tolist())]
        cells += [(direction, None, None, k + 1, 1 - e / whole if whole > 0 else None) for k, e in enumerate(np.atleast_1d(summed).tolist()) if len(by) > 2]
    return rows.sparkSession.createDataFrame(cells, "direction string, fold int, alpha double, rank int, r2 double")


def reduced_rank(rows: DataFrame, vector: str, fold: str, x: list[int], y: list[int], alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0), within: float = 1e-12) -> DataFrame:
    """Held-out R2 over all responses by penalty and rank, (alpha, rank, r2, chosen): the largest alpha within `within`
    of the best full-rank score is chosen. Rank k keeps the k leading directions of the fitted responses.

    One pass of cross products serves every fold, penalty and rank; the rest is small matrices of the products.
    """
    by = gram(rows, vector, fold)
    total, xs, ys = sum(by.values()), [i + 1 for i in x], [i + 1 for i in y]
    top = min(len(x), len(y))
    error, spread = np.zeros((len(alphas), top)), 0.0
    for g in by.values():
        train, n = total - g, g[0, 0]
        spread += float(np.trace(g[np.ix_(ys, ys)]) - (g[0, ys] ** 2).sum() / n)
        m, mx, my = train[0, 0], train[0, xs] / train[0, 0], train[0, ys] / train[0, 0]
        sxy = train[np.ix_(xs, ys)] - m * np.outer(mx, my)
        for a, alpha in enumerate(alphas):
            full = solve(train, x, y, alpha)[1:]
            low = np.linalg.cholesky(train[np.ix_(xs, xs)] - m * np.outer(mx, mx) + m * alpha * np.eye(len(x)))
            v = np.linalg.svd(np.linalg.solve(low, sxy), full_matrices=False)[2]
            for k in range(top):
                b = full @ v[: k + 1].T @ v[: k + 1]
                c = np.vstack([my - mx @ b, b])
                at = [0, *xs]
                error[a, k] += float(np.trace(g[np.ix_(ys, ys)]) - 2 * np.sum(c * g[np.ix_(at, ys)]) + np.sum(c * (g[np.ix_(at, at)] @ c)))
    r2 = 1 - error / spread if spread > 0 else np.full_like(error, math.nan)
    best = max((i for i in range(len(alphas)) if r2[i, -1] >= np.nanmax(r2[:, -1]) - within), key=lambda i: alphas[i], default=-1)
    cells = [(float(alpha), k + 1, float(r2[a, k]), a == best) for a, alpha in enumerate(alphas) for k in range(top)]
    return rows.sparkSession.createDataFrame(cells, "alpha double, rank int, r2 double, chosen boolean")


def similarity_matrix(means: DataFrame, condition: str = "condition", unit: str = "unit", value: str = "mean") -> DataFrame:
    """Pearson correlation of every pair of conditions over the units that both have (a < b; conditions must be few)."""
    a = means.select(unit, F.col(condition).alias("a"), F.col(value).alias("x"))
    b = means.select(unit, F.col(condition).alias("b"), F.col(value).alias("y"))
    return a.join(b, unit).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def rsa(one: DataFrame, other: DataFrame) -> DataFrame:
    """Correlation of two similarity matrices (a, b, r) over the pairs that both have."""
    return one.select("a", "b", F.col("r").alias("x")).join(other.select("a", "b", F.col("r").alias("y")), ["a", "b"]).agg(F.corr("x", "y").alias("rsa"), F.count("*").alias("n"))


def scored(rows: DataFrame, *keys: str) -> DataFrame:
    """Of p and label by key: n, the confusion counts at 0.5 (inclusive), log loss, and average precision (equal scores together)."""
    data = rows.where("p IS NOT NULL AND label IS NOT NULL").withColumn("_hit", (F.col("p") >= 0.5).cast("int")).withColumn("_y", F.col("label").cast("int"))
    cell = lambda h, y: F.count_if((F.col("_hit") == h) & (F.col("_y") == y))
    q = F.greatest(F.least(F.when(F.col("_y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1 - 1e-15)), F.lit(1e-15))
    out = data.groupBy(*keys).agg(F.count("*").alias("n"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"), F.avg(-F.log(q)).alias("log_loss"))
    level = data.groupBy(*keys, "p").agg(F.sum("_y").alias("_k"), F.count("*").alias("_m"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = part.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    level = level.withColumn("_precision", F.sum("_k").over(run) / F.sum("_m").over(run)).withColumn("_gain", F.try_divide(F.col("_k").cast("double"), F.sum("_k").over(part)))
    ap = level.groupBy(*keys).agg(F.sum(F.col("_precision") * F.col("_gain")).alias("average_precision"))
    return out.join(ap, list(keys)) if keys else out.join(F.broadcast(ap))


def session_table(runs: DataFrame, session: str, date: str, decoder: str, score: str) -> DataFrame:
    """One row a session in the order of dates, with the mean score over each decoder's runs in a column of its own (decoders must be few)."""
    wide = runs.groupBy(session, date).pivot(decoder).agg(F.avg(score))
    order = numbered(wide.select(F.lit(0).alias("_all"), session, date), ["_all"], [date, session], "_r").select(F.col(session).alias("_s"), F.col(date).alias("_d"), (F.col("_r") + 1).cast("int").alias("number"))
    return wide.join(order, F.col(session).eqNullSafe(F.col("_s")) & F.col(date).eqNullSafe(F.col("_d"))).drop("_s", "_d")
