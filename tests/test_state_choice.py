"""Models of several state counts and hold-outs, against plain recursions over one sequence."""

import math

import numpy as np
import pytest

from weftline.operators import state_choice as sc


def chains(seed, logistic):
    """Two sessions of two states, as (session, i, x, y)."""
    rng, rows = np.random.default_rng(seed), []
    for session, n in (("a", 230), ("b", 101)):
        state = 0
        for i in range(n):
            state = state if rng.uniform() < 0.95 else 1 - state
            x = float(rng.normal())
            mu = (4 if logistic else 5) * state - 2 + (1 if state else -1) * x
            rows.append((session, i, [x], float(rng.uniform() < 1 / (1 + math.exp(-mu))) if logistic else float(rng.normal(mu, 1))))
    return rows


def plain(model, rows):
    """Log-likelihood of one sequence by the forward recursion in logarithms."""
    a = None
    for _, _, x, y in rows:
        mu = model.weights[:, 0] + model.weights[:, 1:] @ np.array(x)
        ll = -np.logaddexp(0, -mu if y else mu) if model.deviations is None else -0.5 * ((y - mu) / model.deviations) ** 2 - np.log(model.deviations * math.sqrt(2 * math.pi))
        a = (np.log(model.start) if a is None else np.logaddexp.reduce(a[:, None] + np.log(model.transitions), axis=0)) + ll
    return np.logaddexp.reduce(a)


def pieces(rows, out, folds):
    """(sequences learnt from, sequences held out): each session before, inside and after its stretch."""
    learnt, held = [], []
    for name in ("a", "b"):
        mine = [r for r in rows if r[0] == name]
        cut = np.array_split(np.arange(len(mine)), folds)
        if out < 0:
            learnt.append(mine)
        else:
            lo, hi = cut[out][0], cut[out][-1] + 1
            held.append(mine[lo:hi])
            learnt += [s for s in (mine[:lo], mine[hi:]) if s]
    return learnt, held


@pytest.mark.parametrize("logistic", [False, True])
def test_every_model_has_the_likelihood_of_a_plain_recursion(spark, logistic):
    rows = chains(5, logistic)
    df = spark.createDataFrame(rows, "session string, i long, x array<double>, y double")
    models = sc.sweep(df, [1, 2, 3], 3, logistic, steps=6, chunk=37)
    assert [(m.states, m.out) for m in models] == [(k, f) for k in (1, 2, 3) for f in (-1, 0, 1, 2)]
    for m in models:
        learnt, held = pieces(rows, m.out, 3)
        assert m.n == sum(map(len, learnt)) and m.held_n == sum(map(len, held))
        assert abs(m.loglik - sum(plain(m, s) for s in learnt)) < 1e-6 and abs(m.held_loglik - sum(plain(m, s) for s in held)) < 1e-6
        assert np.allclose(m.transitions.sum(axis=1), 1) and abs(m.start.sum() - 1) < 1e-9
    whole = {m.states: m for m in models if m.out < 0}
    assert whole[2].loglik > whole[1].loglik + 20


def test_chunks_do_not_matter_and_no_step_loses(spark):
    rows = chains(9, True)
    df = spark.createDataFrame(rows, "session string, i long, x array<double>, y double")
    few = [sc.sweep(df, [2], 2, True, steps=n, tolerance=0.0, chunk=50) for n in (1, 2, 4)]
    for a, b in zip(few, few[1:], strict=False):
        assert all(y.loglik >= x.loglik - 1e-9 for x, y in zip(a, b, strict=True))
    one = sc.sweep(df, [2], 2, True, steps=4, tolerance=0.0, chunk=10_000)
    assert all(np.allclose(x.weights, y.weights, atol=1e-9) and abs(x.held_loglik - y.held_loglik) < 1e-6 for x, y in zip(few[-1], one, strict=True))


def test_the_right_number_of_states_and_the_least_squares_of_one(spark):
    rows = chains(5, False)
    df = spark.createDataFrame(rows, "session string, i long, x array<double>, y double")
    models = sc.sweep(df, [1, 2], 4, steps=40)
    got = {r["states"]: r for r in sc.scores(spark, models).collect()}
    assert got[2]["held_out"] > got[1]["held_out"] + 0.1 and got[2]["bic"] < got[1]["bic"] and got[2]["stretches"] == 4
    two = next(m for m in models if m.states == 2 and m.out < 0)
    assert np.allclose(two.weights, [[-2, -1], [3, 1]], atol=0.35) and two.transitions.diagonal().min() > 0.85 and two.steps < 40
    one, y, z = next(m for m in models if m.states == 1 and m.out < 0), np.array([r[3] for r in rows]), np.array([[1, r[2][0]] for r in rows])
    best = np.linalg.lstsq(z, y, rcond=None)[0]
    assert np.allclose(one.weights[0], best, atol=1e-6) and abs(one.deviations[0] - np.sqrt(np.mean((y - z @ best) ** 2))) < 1e-6


def test_odd_tables(spark):
    kind = "session string, i long, x array<double>, y double"
    assert sc.sweep(spark.createDataFrame([], kind), [1, 2]) == [] and sc.sweep(spark.createDataFrame([("a", 0, [], 1.0), ("a", 1, [], 1.0)], kind), [1]) == []
    short = sc.sweep(spark.createDataFrame([("a", 0, [], 1.0), ("a", 1, [], 2.0), ("b", 0, [], 3.0)], kind), [1, 2], 5, steps=2)
    assert [m.held_n for m in short if m.states == 1] == [0, 2, 1, 0, 0, 0]
    assert {r["fold"] for r in sc.lengths_of(spark.createDataFrame([("a", i, [], 0.0) for i in range(7)], kind), 3).collect()} == {0, 1, 2}
