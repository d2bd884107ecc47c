"""Operators that SQL cannot express, against numpy and hand-written cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import decoding, hmm, linear, points, ranks, sessions, spectra, targets
from weftline.sources import tables


def signal(spark, values, series=0):
    return spark.createDataFrame([(series, i, float(v)) for i, v in enumerate(values)], "series int, i long, v double")


def test_lowess_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.sin(np.arange(90) / 9) + 0.2 * rng.normal(size=90)
    v[40] += 5
    got = np.array([r["baseline"] for r in spectra.lowess(signal(spark, v), 10, 2, chunk=25).orderBy("i").collect()])
    weight = np.ones(90)
    for n in range(3):
        base = []
        for i in range(90):
            at = np.arange(max(0, i - 10), min(90, i + 11))
            w = (1 - np.abs((at - i) / 11) ** 3) ** 3 * weight[at]
            base.append(np.polyval(np.polyfit(at - i, v[at], 1, w=np.sqrt(w)), 0))
        left = v - np.array(base)
        u = left / (6 * np.median(np.abs(left)))
        weight = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
    assert np.allclose(got, base, atol=1e-6)


def test_pulses_of_a_noisy_line(spark):
    rng = np.random.default_rng(5)
    v = 0.05 * rng.normal(size=400)
    for a, b in ((100, 110), (200, 201), (300, 306), (308, 315)):
        v[a:b] += 3
    got = [(r["start"], r["stop"]) for r in spectra.extract_pulses(signal(spark, v), 50, 3, 3).orderBy("start").collect()]
    assert got == [(100, 110), (300, 315)]


def test_reference_spectra_against_numpy(spark):
    rng = np.random.default_rng(8)
    density = rng.gamma(2, 1, (31, 4))
    density[3, 1], density[5, 2], density[:, 3] = np.nan, 0, 0
    rows = [(i, f, float(density[i, f]), i % 4 != 0) for i in range(31) for f in range(4)] + [(40, 0, None, True)]
    df = spark.createDataFrame(rows, "series int, f int, density double, ok boolean")
    reference = spectra.reference_spectrum(df, "ok")
    want = np.nanmedian(density[[i for i in range(31) if i % 4]], axis=0)
    assert np.allclose([r["reference"] for r in reference.orderBy("f").collect()], want)
    with np.errstate(divide="ignore", invalid="ignore"):
        db = np.where((density > 0) & (want > 0), 10 * np.log10(density / want), np.nan)
    levels = spectra.spectrum_levels(df, reference)
    assert all((r["db"] is None) if r["series"] == 40 or np.isnan(db[r["series"], r["f"]]) else abs(r["db"] - db[r["series"], r["f"]]) < 1e-9 for r in levels.collect())
    got = {r["f"]: (r["n"], r["median"], r["low"], r["high"]) for r in spectra.quartiles(levels, ["f"], "db").collect()}
    assert sorted(got) == [0, 1, 2] and [got[f][0] for f in range(3)] == [31, 30, 30]  # nothing at a reference of 0
    assert all(np.allclose(got[f][1:], np.nanpercentile(db[:, f], [50, 25, 75])) for f in range(3))


def test_debounce(spark):
    rows = [(0, 0.0, 1), (0, 1.0, 0), (0, 1.01, 1), (0, 2.0, 0), (0, 3.0, 1), (0, 3.02, 0), (0, 9.0, 1), (1, 0.0, 1), (1, 5.0, 1), (1, 6.0, 0)]
    got = spectra.debounce(spark.createDataFrame(rows, "line int, t double, state int"), 0.1).collect()
    assert sorted(map(tuple, got)) == [(0, 0.0, 1), (0, 2.0, 0), (0, 9.0, 1), (1, 0.0, 1), (1, 6.0, 0)]


def test_bootstrap_interval_holds_the_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 400)
    rows = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)] + [(1000, "b", 1.0), (1001, "b", 2.0)], "id int, k string, v double")
    got = {r["k"]: r for r in spectra.bootstrap_mean(rows, ["k"], "v", "id", 300).collect()}
    a = got["a"]
    assert abs(a["mean"] - x.mean()) < 1e-9 and a["low"] < a["mean"] < a["high"] and abs((a["high"] - a["low"]) / (2 * 1.96 * x.std() / 20) - 1) < 0.25
    assert not a["unstable"] and got["b"]["unstable"]


def test_derangements_and_their_statistics(spark):
    trials = spark.createDataFrame([("s", t) for t in range(6)] + [("one", 0)], "session string, trial long")
    plan = points.derangements(trials, 8).collect()
    for k in range(8):
        own = {r["target"]: r["source"] for r in plan if r["shuffle"] == k}
        assert sorted(own) == sorted(own.values()) == list(range(6)) and all(a != b for a, b in own.items())
    assert {r["session"] for r in plan} == {"s"}
    rng = random.Random(2)
    phase = {(t, i): rng.uniform(0, 6) for t in range(6) for i in range(10)}
    spikes = [("s", t, "u", rng.randrange(10)) for t in range(6) for _ in range(5)]
    _, null = points.shuffle_null(spark.createDataFrame(spikes, "session string, trial long, unit string, i long"), spark.createDataFrame([("s", t, i, p) for (t, i), p in phase.items()], "session string, trial long, i long, phase double"), 8)
    got = {r["shuffle"]: r["ppc"] for r in null.collect()}
    for k in range(8):
        to = {r["source"]: r["target"] for r in plan if r["shuffle"] == k}
        p = np.array([phase[to[t], i] for _, t, _, i in spikes])
        c = np.cos(p[:, None] - p[None])
        assert abs(got[k] - (c.sum() - len(p)) / (len(p) * (len(p) - 1))) < 1e-9


def test_sampled_phase(spark):
    ph = spark.createDataFrame([("a", 0, 1.0, 0.0, 2.0), ("a", 1, 0.0, 1.0, 4.0), ("a", 2, None, None, 4.0)], "series string, i long, cr double, ci double, amplitude double")
    ev = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.0), ("a", 3, 1.5), ("a", 4, 7.0)], "series string, seq int, t double")
    got = {r["seq"]: r for r in points.sampled_phase(ev, ph, 1.0).collect()}
    assert abs(got[1]["phase"] - math.pi / 4) < 1e-12 and got[1]["amplitude"] == 3 and abs(got[2]["phase"] - math.pi / 2) < 1e-12 and got[3]["phase"] is None and got[4]["phase"] is None
    assert points.sampled_phase(ev, ph, 1.0, 3.5).where("phase IS NOT NULL").count() == 1


@pytest.mark.parametrize("rows, n", [([], 0), ([(1, None), (1, 3.0), (1, 1.0), (1, 2.5), (2, 4.0)] + [(3, float(i % 7)) for i in range(500)], 3)])
def test_quantiles(spark, rows, n):
    got = {r["k"]: r for r in ranks.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", (0.25, 0.5, 0.9)).collect()}
    assert len(got) == n
    for k, r in got.items():
        v = [x for a, x in rows if a == k and x is not None]
        assert np.allclose([r["q0"], r["q1"], r["q2"]], np.quantile(v, [0.25, 0.5, 0.9]))


def vectors(spark, n=300, p=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, rng


def test_poisson_deviance_and_gain(spark):
    x, rng = vectors(spark)
    y = rng.poisson(np.exp(0.3 + x @ [0.8, -0.5, 0.0]))
    rows = spark.createDataFrame([(i % 3, float(v), r.tolist()) for i, (v, r) in enumerate(zip(y, x, strict=True))], "fold int, y double, x array<double>")
    got = {r["fold"]: r for r in decoding.poisson(rows).collect()}
    for k, r in got.items():
        own = y[np.arange(300) % 3 == k]
        null = 2 * sum((v * math.log(v / own.mean()) if v else 0) - (v - own.mean()) for v in own)
        assert abs(r["null_deviance"] - null) < 1e-6 and r["explained"] > 0.4 and r["n"] == 100


def test_reduced_rank_against_numpy(spark):
    x, rng = vectors(spark, 240, 4)
    b = np.outer(rng.normal(size=4), rng.normal(size=3))
    y = x @ b + 0.3 * rng.normal(size=(240, 3)) + 1
    rows = spark.createDataFrame([(i % 4, [*r.tolist(), *v.tolist()]) for i, (r, v) in enumerate(zip(x, y, strict=True))], "fold int, z array<double>")
    got = {(r["alpha"], r["rank"]): r["r2"] for r in decoding.reduced_rank(rows, "z", "fold", [0, 1, 2, 3], [4, 5, 6], (0.01, 0.1)).collect()}
    for alpha in (0.01, 0.1):
        for rank in (1, 2, 3):
            error = spread = 0.0
            for k in range(4):
                a, t = np.arange(240) % 4 != k, np.arange(240) % 4 == k
                xc, yc = x[a] - x[a].mean(0), y[a] - y[a].mean(0)
                g = xc.T @ xc + a.sum() * alpha * np.eye(4)
                full = np.linalg.solve(g, xc.T @ yc)
                v = np.linalg.svd(np.linalg.solve(np.linalg.cholesky(g), xc.T @ yc))[2][:rank]
                p = (x[t] - x[a].mean(0)) @ full @ v.T @ v + y[a].mean(0)
                error += ((y[t] - p) ** 2).sum()
                spread += ((y[t] - y[t].mean(0)) ** 2).sum()
            assert abs(got[alpha, rank] - (1 - error / spread)) < 1e-8
    assert got[0.01, 1] > 0.9 * got[0.01, 3]


def labelled(spark, n=200):
    x, rng = vectors(spark, n)
    return spark.createDataFrame([(i, i % 4, int(r[0] + 0.2 * rng.normal() > 0), r.tolist(), str(i % 3)) for i, r in enumerate(x)], "id int, fold int, label int, x array<double>, condition string")


def test_decoders(spark):
    rows = labelled(spark)
    found = decoding.decode(rows).toPandas()
    assert len(found) == 200 and ((found.p >= 0.5) == (found.label == 1)).mean() > 0.85
    lone = decoding.decode(rows.withColumn("label", F.when(F.col("fold") == 0, F.col("label")).otherwise(0))).toPandas()
    assert (lone[lone.fold == 0].reason == "missing_class").all() and lone[lone.fold == 0].p.isna().all()
    best = decoding.tuned(rows, grid=((0.01, 0.0), (100.0, 1.0))).toPandas()
    assert best.chosen.tolist() == [True, False]
    d = decoding.decodability(rows, "id", 6).first()
    assert d["accuracy"] > 0.85 and d["null_accuracy"] < 0.65 and d["p"] == 1 / 7 and d["reason"] is None
    assert decoding.decodability(rows.where("label = 1"), "id", 2).first()["reason"] == "insufficient_classes"
    shuffled = decoding.shuffled_labels(rows, 1, "id")
    assert shuffled.agg(F.sum("label")).first() == rows.agg(F.sum("label")).first() and shuffled.count() == 200
    moved = decoding.transfer(rows, F.col("fold") < 2, F.col("fold") > 2, "id").toPandas()
    assert set(moved.role) == {"train", "test"} and len(moved) == 150 and ((moved.p >= 0.5) == (moved.label == 1)).mean() > 0.85
    read = decoding.readouts(rows, rows.select(F.col("id").alias("window"), "fold", "x")).toPandas()
    assert len(read) == 200 and np.allclose(sorted(read.p), sorted(found.p), atol=0.2)


def test_shattering_and_trees(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, str(i % 3), (rng.normal(size=3) * 0.1 + np.eye(3)[i % 3]).tolist()) for i in range(240)], "id int, condition string, x array<double>")
    got = decoding.shattering(rows, ["0", "1", "2"], "id").collect()
    assert [r["positive"] for r in got] == ["0", "0,1", "0,2"] and min(r["accuracy"] for r in got) > 0.95
    flat = spark.createDataFrame([(float(i % 2), float(i % 7), i % 2) for i in range(200)], "a double, b double, y int")
    imp = {r["predictor"]: r["importance"] for r in decoding.tree_importance(flat, ["a", "b"], "y").collect()}
    assert imp["a"] > 0.8


def test_penalised_paths(spark):
    x, rng = vectors(spark, 120)
    y = 2 * x[:, 0] + 0.5 * rng.normal(size=120)
    rows = spark.createDataFrame([(i % 4, float(v), r.tolist()) for i, (v, r) in enumerate(zip(y, x, strict=True))], "fold int, y double, x array<double>")
    got = decoding.penalised_paths(rows, penalties=(5.0, 0.2, 0.001)).toPandas()
    assert got.best.sum() == 1 and got.one_se.sum() == 1 and got[got.one_se].penalty.item() >= got[got.best].penalty.item()
    assert got[got.penalty == 5.0].mse.item() > got[got.best].mse.item()
    left = decoding.residuals(rows, 0.001).toPandas()
    assert np.std(left.residual) < 0.6


def test_predictions_from_coefficients(spark):
    x, _ = vectors(spark, 50)
    rows = spark.createDataFrame([(i, [*r.tolist(), float(1 + 2 * r[0] - r[1])]) for i, r in enumerate(x)], "id int, z array<double>")
    p = decoding.predict(rows, linear.ridge(rows, "z", [0, 1, 2], [3]), "z", "id").join(rows, "id").toPandas()
    assert np.allclose(p.value, [z[3] for z in p.z])


def test_hmm_over_chunks_and_em(spark):
    rng = np.random.default_rng(7)
    state, rows, truth = 0, [], []
    for i in range(400):
        state = state if rng.uniform() < 0.95 else 1 - state
        truth.append(state)
        rows.append(("s", i, [], float(rng.normal(4 * state, 1))))
    df = spark.createDataFrame(rows, "session string, i long, x array<double>, y double")
    levels = df.withColumn("ll", hmm.gaussian_levels("y", [0.0, 4.0], [1.0, 1.0]))
    one, many = (hmm.smooth(levels, hmm.sticky(2, 0.95), chunk=c).orderBy("i").toPandas() for c in (10_000, 37))
    assert np.allclose(np.stack(one.posterior), np.stack(many.posterior), atol=1e-9) and abs(one.gain.sum() - many.gain.sum()) < 1e-6
    assert (one.state == truth).mean() > 0.95
    fits = [hmm.fit(df, 2, steps=n) for n in (1, 6)]
    assert fits[1].loglik > fits[0].loglik and np.allclose(sorted(fits[1].weights[:, 0]), [0, 4], atol=0.4) and fits[1].transitions.diagonal().min() > 0.85
    assert all(abs(hmm.loglik(df, m) - m.loglik) < 1e-6 for m in fits)  # of the weights that are returned
    assert abs(hmm.loglik(df, fits[1]) - one.gain.sum()) < 30 and hmm.information(2, 0, -10.0, 100)["parameters"] == 7


def test_cohort_duplicates_are_an_error(spark):
    rows = spark.createDataFrame([("m", 1, 2.0), ("m", 1, 3.0)], "mouse string, day int, v double")
    with pytest.raises(Exception, match="more than one row"):
        sessions.cohort_by_day(rows, "mouse", ["day"], "v").collect()


def test_projected_masks_and_packed_tensors(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "session string, ref int")
    mask = spark.createDataFrame([("s", 1, True), ("s", 2, False)], "session string, seq int, ok boolean")
    assert {r["ref"]: r["ok"] for r in targets.project_mask(rows, mask, "ok").collect()} == {1: True, 2: False, 3: False}
    tensor = spark.createDataFrame([("s", 1, 0, "b", 2), ("s", 1, 0, "a", 1)], "session string, ref int, bin int, unit string, n int")
    assert targets.packed_tensor(tensor).first()["counts"] == [1, 2]


def test_ordered_digests_and_sessions_by_date(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "a|b", "c"), ("k", 2, "d", None), ("j", 1, "a", "b|c"), ("j", 2, "d", None)], "key string, at int, x string, y string")
    one = {r["key"]: r["digest"] for r in tables.ordered_digest(rows, "key", ["at"], ["x", "y"]).collect()}
    back = {r["key"]: r["digest"] for r in tables.ordered_digest(rows.withColumn("at", -F.col("at")), "key", ["at"], ["x", "y"]).collect()}
    assert one["k"] != one["j"] and one["k"] != back["k"]
    for name in ("m1_2024-01-05_task", "m1_2024-02-01_task", "m2_2024-01-05_probe"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}/trials.parquet")
    found = tables.find_sessions(spark, f"{tmp_path}/*/trials.parquet", "2024-01-01", "2024-01-31").collect()
    assert sorted((r["session"], str(r["date"])) for r in found) == [("m1_2024-01-05_task", "2024-01-05"), ("m2_2024-01-05_probe", "2024-01-05")]
    assert [r["session"] for r in tables.find_sessions(spark, f"{tmp_path}/*/trials.parquet", "2024-01-01", "2024-12-31", "m1").orderBy("date").collect()] == ["m1_2024-01-05_task", "m1_2024-02-01_task"]


def test_p_values_of_t(spark):
    known = [(2.0, 10.0, 0.07338803), (0.0, 5.0, 1.0), (-3.5, 3.0, 0.03948074), (1.96, 1000.0, 0.05027293), (12.706, 1.0, 0.05000080), (None, 3.0, None), (1.0, None, None)]
    got = sessions.p_values(spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(known)], "i int, t double, f double"), "t", "f").orderBy("i").collect()
    for r, (_, _, p) in zip(got, known, strict=True):
        assert (r["p"] is None) == (p is None) and (p is None or abs(r["p"] - p) < 1e-6)


def test_the_entry_imports_before_a_session_is_there():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, check=False).returncode == 0


def test_a_gap_in_trial_numbers_ends_an_episode(spark):
    # R on the left, then a new block: wrong repeat of the left, then R on the right
    def found(numbers):
        rows = [("s", k, k, n, a, r, b, st, int(a == st), True) for k, (n, (a, r, b, st)) in enumerate(zip(numbers, [(1, 1, 0, 1), (1, 0, 1, 0), (0, 1, 1, 0)], strict=True))]
        df = spark.createDataFrame(rows, "session string, t long, seq long, trial long, action int, reward int, block int, state int, correct int, valid boolean")
        return [r["seqs"] for r in targets.transitions(df).collect()], targets.probes(df).count()

    assert found([1, 2, 3])[0] == [[0, 1, 2]]
    assert found([1, 2, 9]) == ([], 0) and found([1, 3, 4]) == ([], 0) and found([1, None, 3]) == ([], 0)


def test_shuffled_labels_keep_counts_by_group_over_many_tasks(spark):
    rows = spark.range(0, 3000, 1, 5).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7 < 2).cast("int").alias("label"))
    got = decoding.shuffled_labels(rows, 3, "id", ["g"])
    count = lambda df: {(r["g"], r["label"]): r["count"] for r in df.groupBy("g", "label").count().collect()}
    assert count(got) == count(rows) and got.join(rows.withColumnRenamed("label", "was"), "id").where("label != was").count() > 800
    again = decoding.shuffled_labels(rows.repartition(9), 3, "id", ["g"])
    assert {tuple(r) for r in again.select("id", "label").collect()} == {tuple(r) for r in got.select("id", "label").collect()}


def test_penalties_of_inner_folds_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(240, 3))
    data = np.hstack([data, data @ rng.normal(size=(3, 2)) + rng.normal(size=(240, 2))])
    fold, alphas = np.arange(240) % 4, (1e-3, 0.1, 1.0)
    df = spark.createDataFrame([(int(f), [float(v) for v in r]) for f, r in zip(fold, data, strict=True)], "fold int, v array<double>")
    got = {(r["direction"], r["fold"]): (r["alpha"], r["r2"]) for r in decoding.nested_rank(df, "v", "fold", [0, 1, 2], [3, 4], alphas).collect() if r["rank"] == 2}

    def error(train, test, a, b, alpha):
        x, y = data[train][:, a], data[train][:, b]
        xc, yc = x - x.mean(0), y - y.mean(0)
        w = np.linalg.solve(xc.T @ xc + len(x) * alpha * np.eye(len(a)), xc.T @ yc)
        fit = (data[test][:, a] - x.mean(0)) @ w + y.mean(0)
        return ((data[test][:, b] - fit) ** 2).sum()

    for name, a, b in (("forward", [0, 1, 2], [3, 4]), ("backward", [3, 4], [0, 1, 2])):
        for o in range(4):
            inner = [sum(error((fold != o) & (fold != i), fold == i, a, b, p) for i in range(4) if i != o) for p in alphas]
            best = alphas[int(np.argmin(inner))]
            y = data[fold == o][:, b]
            if name == "forward":  # of full rank, so that the plain ridge fit is the model
                assert np.isclose(got[name, o][1], 1 - error(fold != o, fold == o, a, b, best) / ((y - y.mean(0)) ** 2).sum())
            assert got[name, o][0] == best
    assert (("forward", None) in got) and decoding.nested_rank(df.where("fold < 2"), "v", "fold", [0, 1], [2], alphas).count() == 0


def test_shuffle_null_ships_each_spike_once_and_counts_trials_over_stretches(spark):
    rng = random.Random(5)
    phase = {(s, t, i): rng.uniform(0, 6) for s in "ab" for t in range(5) for i in range(30) if rng.random() < 0.8} | {("c", 0, i): 1.0 for i in range(30)}
    spikes = [(s, rng.randrange(1 if s == "c" else 5), rng.choice(["u", None]), rng.randrange(30)) for s in "aabbc" for _ in range(40)]
    df = spark.createDataFrame(spikes, "session string, trial long, unit string, i long")
    ph = spark.createDataFrame([(*k, p) for k, p in phase.items()], "session string, trial long, i long, phase double")
    plan = [(k, r["session"], r["source"], r["target"]) for r in points.derangements(ph.select("session", "trial"), 6).collect() for k in [r["shuffle"]]]
    plan += [(-1, s, t, t) for s, n in (("a", 5), ("b", 5), ("c", 1)) for t in range(n)]
    want = {}
    for k, s, source, target in plan:
        for s2, t, u, i in spikes:
            if (s2, t) == (s, source) and (s, target, i) in phase:
                want.setdefault((k, s, u), []).append((t, phase[s, target, i]))
    for width in (4096, 7):
        observed, null = points.shuffle_null(df, ph, 6, width=width)
        assert "explode(sequence" not in null._jdf.queryExecution().toString()  # no row for each spike and shuffle
        got = {(r["shuffle"], r["session"], r["unit"]): r for r in null.collect()} | {(-1, r["session"], r["unit"]): r for r in observed.collect()}
        assert set(got) == set(want)
        for key, met in want.items():
            c = np.cos(np.subtract.outer([p for _, p in met], [p for _, p in met]))
            n = len(met)
            assert (got[key]["n"], got[key]["trials"]) == (n, len({t for t, _ in met})) and (n < 2 or abs(got[key]["ppc"] - (c.sum() - n) / (n * (n - 1))) < 1e-9)
