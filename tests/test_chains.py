"""Hidden chains of many short sessions, side by side in a task, against plain recursions over one sequence."""

import math

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import chains, hmm
from weftline.operators import state_choice as sc

KIND = "session string, i long, x array<double>, y double"


def uneven(seed=3):
    """Sessions of 1 to 40 rows, one of them without a name."""
    rng = np.random.default_rng(seed)
    return [(None if n == 17 else f"s{n}", i, [float(rng.normal())], float(rng.uniform() < 0.5)) for n in range(1, 41) for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().toString()


def plain(ll, moves):
    """Posteriors of one sequence by both recursions, and its log-likelihood."""
    a, b, total = [np.full(len(moves), 1 / len(moves)) * np.exp(ll[0])], [np.ones(len(moves))], 0.0
    for v in ll[1:]:
        a.append(a[-1] @ moves * np.exp(v))
    for v in ll[:0:-1]:
        b.append(moves @ (np.exp(v) * b[-1]))
    total = a[-1].sum()
    return np.array(a) * np.array(b[::-1]) / total, math.log(total)


def test_smoothing_steps_through_many_sessions_at_once(spark):
    rows, moves = uneven(), hmm.sticky(3, 0.8)
    df = spark.createDataFrame(rows, KIND).withColumn("ll", F.array(*[-((F.get("x", F.lit(0)) - float(m)) ** 2) for m in (-1, 0, 1)]))
    for chunk in (4, 100):
        got = hmm.smooth(df, moves, chunk=chunk)
        assert "FlatMapGroups" not in plan(got) and "FlatMapCoGroups" not in plan(got)  # no call of Python for each chunk
        cells = {(r["session"], r["i"]): r for r in got.collect()}
        assert len(cells) == len(rows)
        for n in range(1, 41):
            name = None if n == 17 else f"s{n}"
            ll = np.array([[-((r[2][0] - m) ** 2) for m in (-1, 0, 1)] for r in rows if r[0] == name])
            post, total = plain(ll, moves)
            mine = [cells[name, i] for i in range(n)]
            assert np.allclose([r["posterior"] for r in mine], post, atol=1e-9) and abs(sum(r["gain"] for r in mine) - total) < 1e-9
            assert mine[0]["xi"] is None and all(np.allclose(np.reshape(r["xi"], (3, 3)).sum(axis=0), r["posterior"], atol=1e-9) for r in mine[1:])


def test_a_session_without_a_name_is_learnt_from(spark):
    df = spark.createDataFrame(uneven(), KIND)
    named = df.withColumn("session", F.coalesce("session", F.lit("none")))
    for logistic in (False, True):
        a, b = (hmm.fit(d, 2, logistic, steps=3, tolerance=0.0) for d in (df, named))
        assert np.allclose(a.weights, b.weights, atol=1e-7) and abs(a.loglik - b.loglik) < 1e-6 and abs(a.loglik - hmm.loglik(df, a)) < 1e-6


def test_logistic_weights_are_the_optimum_under_their_chances(spark):
    df = spark.createDataFrame(uneven(), KIND)
    one, two = (hmm.fit(df, 2, True, steps=n, tolerance=0.0) for n in (2, 3))
    post = hmm.smooth(df.withColumn("ll", one.levels()), one.transitions).select("session", "i", "posterior")
    rows = df.join(post, df["session"].eqNullSafe(post["session"]) & (df["i"] == post["i"])).select("x", "y", "posterior").collect()
    x, y = np.array([[1, r["x"][0]] for r in rows]), np.array([r["y"] for r in rows])
    for k in range(2):
        g = np.array([r["posterior"][k] for r in rows])
        spread = np.average(x[:, 1] ** 2, weights=g) - np.average(x[:, 1], weights=g) ** 2
        slope = (g * (y - 1 / (1 + np.exp(-x @ two.weights[k])))) @ x / g.sum() - 1e-4 * np.array([0, spread]) * two.weights[k]
        assert np.abs(slope).max() < 1e-9
    same = hmm.fit(df.withColumn("y", F.lit(1.0)), 2, True, steps=2)
    assert np.isposinf(same.weights[:, 0]).all() and abs(same.loglik) < 1e-9


def test_long_sessions_are_chunks_with_known_ends(spark):
    df = spark.createDataFrame(uneven(), KIND)
    for logistic in (False, True):
        a, b = (hmm.fit(df, 2, logistic, steps=3, tolerance=0.0, chunk=c) for c in (7, 4096))
        assert np.allclose(a.weights, b.weights, atol=1e-7) and np.allclose(a.transitions, b.transitions, atol=1e-9) and abs(a.loglik - b.loglik) < 1e-7
    told = {(r["session"], r["chunk"]): r for r in chains.packed(df, 7, ["x"], ["y"]).collect()}
    assert told["s40", 5]["first"] == 35 and len(told["s40", 5]["x"]) == len(told["s40", 5]["y"]) == 5


def test_a_session_without_a_name_is_in_every_model(spark):
    df = spark.createDataFrame(uneven(), KIND)
    a, b = (sc.sweep(d, [1, 2], 3, steps=2) for d in (df, df.withColumn("session", F.coalesce("session", F.lit("none")))))
    assert [(m.n, m.held_n) for m in a] == [(m.n, m.held_n) for m in b] and all(abs(x.loglik - y.loglik) < 1e-6 for x, y in zip(a, b, strict=True))
