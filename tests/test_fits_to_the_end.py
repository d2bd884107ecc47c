"""Fits that run until they gain nothing, against a plain EM over the sessions of a small table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import queries_more as more
from weftline.operators import hmm

SF = "/root/testdata/sf0.001"


def sessions(df):
    """x (session, row, input) with a one first, y and which rows there are, of rows (session, i, x, y)."""
    rows = df.collect()
    names = sorted({r["session"] for r in rows})
    n, q = max(r["i"] for r in rows) + 1, 1 + len(rows[0]["x"])
    x, y, real = np.zeros((len(names), n, q)), np.zeros((len(names), n)), np.zeros((len(names), n), bool)
    for r in rows:
        at = names.index(r["session"]), r["i"]
        x[at], y[at], real[at] = [1, *r["x"]], r["y"], True
    return x, y, real


def plain(x, y, real, states, least=1e-6):
    """EM, one row of all sessions at a time, until a step gains less than `least`: weights, deviations, moves, log-likelihoods."""
    values, n = y[real], real.shape[1]
    weights = np.zeros((states, x.shape[2]))
    weights[:, 0] = np.quantile(values, [(k + 0.5) / states for k in range(states)])
    sd, moves, told = np.full(states, values.std(ddof=1)), hmm.sticky(states), []
    while True:
        mu = x @ weights.T
        e = np.where(real[..., None], np.exp(-0.5 * ((y[..., None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)), 1.0)
        a, b, total = np.empty_like(e), np.ones_like(e), 0.0
        for t in range(n):
            v = (a[:, t - 1] @ moves if t else np.full((len(x), states), 1 / states)) * e[:, t]
            total += np.log(v.sum(axis=1))[real[:, t]].sum()
            a[:, t] = v / v.sum(axis=1, keepdims=True)
        for t in range(n - 2, -1, -1):
            v = (e[:, t + 1] * b[:, t + 1]) @ moves.T
            b[:, t] = np.where(real[:, t + 1, None], v / v.max(axis=1, keepdims=True), 1.0)
        told.append(total)
        if len(told) > 1 and told[-1] - told[-2] < least:
            return weights, sd, moves, told
        post = a * b / (a * b).sum(axis=2, keepdims=True) * real[..., None]
        xi = a[:, :-1, :, None] * moves * (e * b)[:, 1:, None, :]
        xi = (xi / xi.sum(axis=(2, 3), keepdims=True) * real[:, 1:, None, None]).sum(axis=(0, 1))
        moves = xi / xi.sum(axis=1, keepdims=True)
        weights = np.stack([np.linalg.solve(np.einsum("st,sti,stj->ij", g, x, x), np.einsum("st,sti,st->i", g, x, y)) for g in post.transpose(2, 0, 1)])
        sd = np.sqrt(np.einsum("stk,stk->k", post, (y[..., None] - x @ weights.T) ** 2) / post.sum(axis=(0, 1)))


def test_the_linear_model_is_fitted_to_its_optimum(spark):
    rows = more._sequence(spark, SF).withColumn("x", F.array((F.col("i") % 2).cast("double")))
    weights, sd, moves, told = plain(*sessions(rows), 2)
    assert len(told) > 50  # far from done after six steps
    got = sorted(more.QUERIES["m22_linear_hmm"](spark, SF).collect(), key=lambda r: r["state"])
    assert all(told[-1] - 1e-6 <= r["loglik"] <= told[-1] + 1e-3 for r in got)
    assert np.allclose([r["weights"] for r in got], weights, rtol=5e-3) and np.allclose([r["deviation"] for r in got], sd, rtol=5e-3)
    assert np.allclose([r["moves"] for r in got], moves, atol=5e-3)
    assert abs(got[0]["aic"] - 2 * 9 + 2 * got[0]["loglik"]) < 1e-6


def test_the_gaussian_model_is_fitted_to_its_optimum(spark):
    rows = more._sequence(spark, SF)
    weights, sd, moves, told = plain(*sessions(rows), 3)
    assert len(told) > 100  # far from done after six steps
    got = sorted(more.QUERIES["m23_gaussian_hmm"](spark, SF).collect(), key=lambda r: r["state"])
    assert np.allclose([r["mean"] for r in got], weights[:, 0], rtol=5e-3) and np.allclose([r["deviation"] for r in got], sd, rtol=5e-3)


def normal(spark):
    """Two states that overlap, so that EM goes slowly."""
    rng, rows = np.random.default_rng(7), []
    for s in range(6):
        state = 0
        for i in range(40 + s):
            state = state if rng.uniform() < 0.8 else 1 - state
            rows.append((f"s{s}", i, [float(1000 * rng.normal())], float(rng.normal(2 * state, 1))))
    return spark.createDataFrame(rows, "session string, i long, x array<double>, y double")


def test_going_ahead_ends_at_the_optimum_of_plain_steps(spark, monkeypatch):
    df, passes, known = normal(spark), [], hmm.sums
    monkeypatch.setattr(hmm, "sums", lambda *a, **k: passes.append(1) or known(*a, **k))
    weights, sd, moves, told = plain(*sessions(df), 2)
    model = hmm.fit(df, 2, steps=1000, tolerance=1e-6 / df.count(), ahead=10)
    assert told[-1] - 1e-6 <= model.loglik <= told[-1] + 1e-3 and len(passes) < len(told) / 2
    assert np.allclose(model.weights, weights, rtol=2e-2, atol=1e-4) and np.allclose(model.deviations, sd, rtol=5e-3) and np.allclose(model.transitions, moves, atol=5e-3)
    few = [hmm.fit(df, 2, steps=n, tolerance=0.0, ahead=10).loglik for n in (6, 13, 14, 15)]
    assert few == sorted(few) and abs(few[0] - told[6]) < 1e-6


@pytest.mark.parametrize("worse", [-3.0, math.nan])
def test_a_lead_that_loses_is_dropped(spark, monkeypatch, worse):
    df, known, asked = normal(spark), hmm._onward, []
    monkeypatch.setattr(hmm, "_onward", lambda steps: asked.append(1) or (known(steps) if len(asked) > 2 else steps[-1][1] + worse))
    told = plain(*sessions(df), 2)[3]
    model = hmm.fit(df, 2, steps=1000, tolerance=1e-6 / df.count(), ahead=10)
    assert len(asked) > 3 and told[-1] - 1e-6 <= model.loglik <= told[-1] + 1e-3
    asked.clear()
    last = 1 + next(i for i in range(1, len(told)) if told[i] - told[i - 1] < 1e-4 * df.count())
    model = hmm.fit(df, 2, steps=last, tolerance=0.0, ahead=10)  # ends at the lead that loses
    assert len(asked) == 1 and abs(model.loglik - told[last - 1]) < 1e-6
