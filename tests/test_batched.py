"""Models fitted together, held against Spark ML, closed forms and the conditions of an optimum."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from weftline.operators import batched as ba
from weftline.operators import decoding, linear


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.2, 1, 1] + [0, 5, 0, -2, 0]
    x[:, 4] = 7.0  # constant
    eta = x[:, 0] - 0.4 * (x[:, 1] - 5) + 2 * x[:, 2]
    y, counts = (rng.random(400) < 1 / (1 + np.exp(-eta))).astype(int), rng.poisson(np.exp(0.4 * x[:, 0] + 0.2))
    rows = [(i, i % 4, i % 3, int(a), float(c), r.tolist()) for i, (a, c, r) in enumerate(zip(y, counts, x, strict=True))]
    return spark.createDataFrame(rows, "id int, fold int, bin int, label int, y double, x array<double>").repartition(5)


def test_logistic_fits_equal_spark_ml(noisy):
    models = [ba.Model(0, k, 0, None, p, m) for k in (None, 1) for p, m in ((0.01, 0.0), (0.05, 0.5), (0.1, 1.0), (10.0, 1.0))]
    rows = ba.laid(noisy, F.array("label"))
    fits = ba.fit(rows, models)
    assert all(f.status == "ok" for f in fits) and max(f.passes for f in fits) <= 40
    for f in fits:
        train = noisy.where(F.col("fold") != f.model.fold) if f.model.fold is not None else noisy
        ml = LogisticRegression(featuresCol="v", labelCol="label", regParam=f.model.penalty, elasticNetParam=f.model.mix, maxIter=500, tol=1e-12).fit(train.withColumn("v", array_to_vector("x")))
        assert np.allclose(f.weights, ml.coefficients.toArray(), atol=1e-4) and abs(f.intercept - ml.intercept) < 1e-3
    assert max(r["violation"] for r in ba.violations(rows, fits, "logistic", 5).collect() if r["violation"] is not None) < 1e-6
    assert all(w == 0 for w in fits[3].weights)


def test_poisson_fits_columns_and_granger(noisy):
    rows = ba.laid(noisy, F.array("y", F.when(F.col("id") < 300, F.col("y") * 0)))
    full, part, zero = ba.fit(rows, [ba.Model(), ba.Model(columns=(1, 2)), ba.Model(response=1)], "poisson")
    glm = GeneralizedLinearRegression(featuresCol="v", labelCol="y", family="poisson", link="log", tol=1e-12).fit(noisy.withColumn("v", array_to_vector(F.slice("x", 1, 4))))
    assert np.allclose(full.weights[:4], glm.coefficients.toArray(), atol=1e-5) and full.weights[4] == 0
    assert part.weights[0] == part.weights[3] == 0 and part.loss > full.loss and zero.status == "all_zero"
    got = ba.poisson_granger(rows, 2, [[1], [1]], [[0], [0]]).collect()
    assert got[0]["p"] < 1e-6 and got[0]["freedom"] == 1 and got[0]["status"] == "ok" and got[1]["status"] == "all_zero" and got[1]["p"] is None
    assert ba.poisson_granger(rows, 1, [[0]], [[2]]).first()["p"] > 1e-3


def test_cells_weights_and_rows_that_take_no_part(noisy, spark):
    odd = noisy.withColumn("x", F.when(F.col("id") == 3, F.lit(None)).when(F.col("id") == 4, F.array(*[F.lit(float("nan"))] * 5)).otherwise(F.col("x")))
    fits = ba.fit(ba.laid(odd, F.array("label"), cell="bin"), [ba.Model(cell=b, penalty=0.1) for b in (0, 1, 2, 9)])
    lone = ba.fit(ba.laid(odd.where("bin = 1"), F.array("label")), [ba.Model(penalty=0.1)])[0]
    assert np.allclose(fits[1].weights, lone.weights, atol=1e-9) and fits[3].status == "no_rows"
    twice = ba.fit(ba.laid(noisy.union(noisy), F.array("label")), [ba.Model(penalty=0.1)])[0]
    heavy = ba.fit(ba.laid(noisy.withColumn("two", F.lit(2.0)), F.array("label"), weight="two"), [ba.Model(penalty=0.1)])[0]
    assert np.allclose(twice.weights, heavy.weights, atol=1e-3)
    assert ba.fit(ba.laid(noisy.limit(0), F.array("label")), [ba.Model()])[0].status == "no_rows"
    nofold = ba.fit(ba.laid(noisy.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold"))), F.array("label")), [ba.Model(fold=1, penalty=0.1), ba.Model(penalty=0.1)])
    assert nofold[0].n == 200 and nofold[1].n == 400


def test_groups_of_models_take_scans_of_their_own(noisy, monkeypatch):
    models = [ba.Model(0, k, 0, None, 0.1, 0.5) for k in range(4)]
    together = ba.fit(ba.laid(noisy, F.array("label")), models)
    monkeypatch.setattr(ba, "HELD", 40)
    apart = ba.fit(ba.laid(noisy, F.array("label")), models)
    assert all(np.allclose(a.weights, b.weights, atol=1e-9) for a, b in zip(together, apart, strict=True))


def test_tuned_by_bin_is_the_best_mean_over_folds(noisy):
    grid = ((0.01, 0.0), (0.05, 1.0), (50.0, 1.0))
    got = decoding.tuned(noisy, grid=grid, cell="bin").toPandas()
    assert len(got) == 9 and got.groupby("bin").chosen.sum().tolist() == [1, 1, 1]
    for (b, i), cell in got.groupby(["bin", "candidate"]):
        own = decoding.decode(noisy.where(F.col("bin") == int(b)), penalty=grid[i][0], mix=grid[i][1]).toPandas()
        assert abs(((own.p >= 0.5) == (own.label == 1)).groupby(own.fold).mean().mean() - cell.score.item()) < 1e-12
    for _, cell in got.groupby("bin"):
        assert cell[cell.chosen].candidate.item() == cell[cell.score == cell.score.max()].candidate.min()


def test_elastic_net_path_equals_spark_ml_and_its_conditions(noisy):
    rows = noisy.withColumn("y", F.col("y") + F.get("x", F.lit(1)))
    w = decoding.penalised_weights(rows, (0.5, 0.1, 0.01))
    got = {p: g.set_index("term").coefficient for p, g in w.toPandas().groupby("penalty")}
    for p, own in got.items():
        ml = LinearRegression(featuresCol="v", labelCol="y", regParam=p, elasticNetParam=1.0, maxIter=500, tol=1e-12).fit(rows.withColumn("v", array_to_vector("x")))
        assert np.allclose(own[[0, 1, 2, 3, 4]], ml.coefficients.toArray(), atol=5e-3) and own[4] == 0
    for mix in (0.0, 0.5, 1.0):
        away = decoding.penalised_violations(rows, decoding.penalised_weights(rows, (0.5, 0.1, 0.01), mix), 5, mix).toPandas()
        assert len(away) == 18 and away.violation.max() < 1e-7


def test_chi_square_tail():
    for x, k, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (11.344866730144373, 3, 0.01), (9.487729036781154, 4, 0.05), (18.307038053275146, 10, 0.05)):
        assert math.isclose(ba.chi_square_tail(x, k), p, rel_tol=1e-9)
    assert ba.chi_square_tail(0.0, 3) == 1.0


def test_cca_axes_pair_signs_and_leave_constants(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(size=200)
    z = np.column_stack([t + 0.1 * rng.normal(size=200), rng.normal(size=200), np.full(200, 4.0), -3 * t + 10 + 0.1 * rng.normal(size=200), rng.normal(size=200)])
    rows = spark.createDataFrame([(r.tolist(),) for r in z], "z array<double>")
    axes = linear.cca_axes(rows, "z", [0, 1, 2], [3, 4])
    first = axes.first()
    assert first["a"][0] > 0 and first["a"][2] == 0 and first["b"][0] < 0 and first["correlation"] > 0.98
    assert np.allclose([r["correlation"] for r in axes.collect()], [r["correlation"] for r in linear.cca(rows, "z", [0, 1, 2], [3, 4]).collect()])
    got = np.array([[*r["u"], *r["v"]] for r in linear.cca_transform(rows, axes, "z", [0, 1, 2], [3, 4]).collect()])
    assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose(got.std(0), 1) and abs(np.corrcoef(got[:, 0], got[:, 2])[0, 1] - first["correlation"]) < 1e-9
    assert linear.cca_axes(rows.limit(0), "z", [0], [1]).count() == 0 and linear.cca_axes(rows, "z", [2], [3]).count() == 0
