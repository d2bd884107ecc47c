"""Hidden Markov models over long sessions: smoothing by chunk transfer matrices, EM with linear or logistic emissions.

A chunk of rows acts on the vector of state chances as one small matrix. The matrices of all chunks are worked out in
parallel, one short fold over a session's chunks gives the vectors at their ends, and a second parallel pass fills the
chunks in; so no task holds a session. A task steps through many chunks side by side (chains).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.chains import Group, Steps, backward, blocks, ends, flat, forward, lists, packed, products, sums, with_ends
from weftline.operators.ranks import quantiles
from weftline.sources.scratch import written


def sticky(states: int, stay: float = 0.9) -> np.ndarray:
    """Transitions with chance `stay` to stay, the rest shared equally."""
    return np.full((states, states), (1 - stay) / max(states - 1, 1)) + (stay - (1 - stay) / max(states - 1, 1)) * np.eye(states) if states > 1 else np.ones((1, 1))


def gaussian_levels(value: str, means: Sequence[float], deviations: Sequence[float]) -> Column:
    """Log-likelihoods of a value under fixed Gaussians, one for each state; 0 for all where it is null."""
    each = [-0.5 * ((F.col(value) - float(m)) / float(s)) ** 2 - math.log(s * math.sqrt(2 * math.pi)) for m, s in zip(means, deviations, strict=True)]
    return F.array(*[F.coalesce(e, F.lit(0.0)) for e in each])


def independent_probabilities(levels: str) -> Column:
    """Each state's share of a row's likelihoods alone."""
    top = F.array_max(levels)
    parts = F.transform(levels, lambda v: F.exp(v - top))
    return F.transform(parts, lambda v: v / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def smooth(rows: DataFrame, transitions: np.ndarray, start: np.ndarray | None = None, chunk: int = 4096) -> DataFrame:
    """Rows (session, i from 0 without gaps, ll) with posterior (array by state), xi (chances of the transition into the
    row, flat; null for the first), state (the likeliest, the first of equals) and gain (the row's part of the log-likelihood)."""
    k = len(transitions)
    pi, moves = (np.full(k, 1 / k) if start is None else np.asarray(start, float))[None], np.asarray(transitions, float)[None]
    kind = dict(rows.dtypes)["session"]
    chunks = packed(rows, chunk, ["ll"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for b, lengths in blocks(batch, pc.list_value_length(batch["ll"]).to_numpy(zero_copy_only=False) // k):
                steps = Steps(lengths)
                ll = flat(b["ll"]).reshape(-1, k).T[:, steps.rows]
                top, i = ll.max(axis=0), b["first"].to_numpy()[steps.run] + steps.step
                yield b, steps, np.exp(ll - top)[None], top, i, (i == 0)[None]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, steps, e, _, _, fresh in each(batches):
            yield pa.RecordBatch.from_arrays([b["session"], b["chunk"], lists(products(steps, e, fresh, moves, pi).reshape(-1, k * k))], ["session", "chunk", "m"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, steps, e, top, i, fresh in each(batches):
            before, after = (flat(b[c]).reshape(-1, k)[steps.order].T[None] for c in ("before", "after"))
            a, total = forward(steps, e, fresh, before, moves, pi)
            later = backward(steps, e, fresh, after, moves)
            post = a[0, :, steps.runs :] * later[0]
            post /= post.sum(axis=0)
            xi = (a[0][:, None, steps.before] * transitions[:, :, None] * (e * later)[0]).reshape(k * k, -1)
            xi /= xi.sum(axis=0)
            back = np.empty(len(i), np.int64)
            back[steps.rows] = np.arange(len(i))
            cells = [b["session"].take(pa.array(steps.run[back])), pa.array(i[back], pa.int64()), lists(post.T[back]), lists(xi.T[back], fresh[0, back]), pa.array(post.argmax(axis=0)[back], pa.int32()), pa.array((np.log(total[0]) + top)[back])]
            yield pa.RecordBatch.from_arrays(cells, ["session", "i", "posterior", "xi", "state", "gain"])

    vectors = ends(chunks.mapInArrow(product, f"session {kind}, chunk bigint, m array<double>"), [(1, k)])
    return with_ends(chunks, vectors).mapInArrow(fill, f"session {kind}, i bigint, posterior array<double>, xi array<double>, state int, gain double")


@dataclass(frozen=True)
class Hmm:
    """weights: (states, 1 + inputs), the intercept first; deviations are None for logistic emissions."""

    weights: np.ndarray
    deviations: np.ndarray | None
    transitions: np.ndarray
    loglik: float

    def levels(self) -> Column:
        """Log-likelihoods of y given x by state."""
        out = []
        for k, w in enumerate(self.weights):
            mu = F.lit(float(w[0]))
            for j, c in enumerate(w[1:]):
                mu = mu + float(c) * F.get("x", F.lit(j))
            if self.deviations is None:
                out.append(-F.log1p(F.exp(F.when(F.col("y") == 1, -mu).otherwise(mu))))
            else:
                s = float(self.deviations[k])
                out.append(-0.5 * ((F.col("y") - mu) / s) ** 2 - math.log(s * math.sqrt(2 * math.pi)))
        return F.array(*out)


def _logistic(held: DataFrame, group: Group, got: np.ndarray, inputs: int, whole: bool, ridge: float = 1e-4, most: int = 40) -> np.ndarray:
    """Weights by state that minimise the mean loss under the group's chances, plus half the ridge times the squares of the
    weights, each times its input's spread, the intercept aside. Newton steps, one pass each for all states, halved where the loss
    grows; got holds the sums at the group's own weights. An input of one value has no weight; of one kind of y the intercept is infinite.
    """
    k, q = group.states, inputs + 1
    at = np.cumsum([4, k * k, k, k * (q + 1) ** 2, k * q, k * q * q])
    both = got[at[2] : at[3]].reshape(k, q + 1, q + 1)
    mass, squares = np.maximum(both[:, 0, 0], 1e-300), np.diagonal(both, axis1=1, axis2=2)[:, :q]
    spread = squares / mass[:, None] - (both[:, 0, :q] / mass[:, None]) ** 2
    fixed = spread <= 1e-12 * squares / mass[:, None]
    fixed[:, 0] = False
    pull = ridge * np.where(fixed, 0, np.maximum(spread, 0)) * mass[:, None]
    ones = both[:, 0, q]
    if (ones == 0).all() or (ones == both[:, 0, 0]).all():
        return np.column_stack([np.full(k, math.inf if ones.any() else -math.inf), np.zeros((k, inputs))])

    def at_point(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope = np.where(fixed, 0, v[at[3] : at[4]].reshape(k, q) - pull * w)
        curve = v[at[4] : at[5]].reshape(k, q, q) * ~fixed[:, :, None] * ~fixed[:, None, :] + (pull + fixed + 1e-12 * mass[:, None])[:, :, None] * np.eye(q)
        return v[at[5] :] + (pull * w * w).sum(axis=1) / 2, np.linalg.solve(curve, slope[..., None])[..., 0]

    w = np.where(fixed, 0, group.weights[0])
    if fixed.any():
        got = sums(held, [replace(group, point=w[None])], inputs, whole)[0][0]
    loss, step = at_point(got, w)
    for _ in range(most):
        if (np.abs(step) <= 1e-6 * np.maximum(1, np.abs(w))).all():
            break
        tried = w + step
        new, onward = at_point(sums(held, [replace(group, point=tried[None])], inputs, whole)[0][0], tried)
        good = (new <= loss + 1e-12 * np.abs(loss))[:, None]
        w, loss, step = np.where(good, tried, w), np.where(good[:, 0], new, loss), np.where(good, onward, step / 2)
    else:
        return w
    return w + step


def _numbers(group: Group, units: np.ndarray) -> np.ndarray:
    """A model as one vector: weights in units of their inputs, logarithms of transitions and deviations."""
    return np.concatenate([(group.weights[0] / units).ravel(), np.log(group.transitions[0]).ravel(), np.log(group.deviations[0])])


def _model(group: Group, numbers: np.ndarray, units: np.ndarray, least: float) -> Group:
    """The model of such a vector, no transition less than `least`."""
    k, q = group.weights[0].shape
    weights, moves, deviations = np.split(numbers, [k * q, k * q + k * k])
    with np.errstate(over="ignore"):
        moves = np.maximum(np.exp(moves - moves.reshape(k, k).max(axis=1).repeat(k)), least).reshape(k, k)
        return replace(group, weights=(weights.reshape(k, q) * units)[None], deviations=np.exp(deviations)[None], transitions=(moves / moves.sum(axis=1, keepdims=True))[None])


def _onward(steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where EM steps (from, to) that go on as these do would come to rest (Anderson's mixing): the last one's end, less those
    shares of the changes between steps that leave the least of its way."""
    to = np.array([b for _, b in steps])
    way = to - np.array([a for a, _ in steps])
    shares = np.linalg.lstsq(np.diff(way, axis=0).T, way[-1], rcond=1e-10)[0]
    return to[-1] - shares @ np.diff(to, axis=0)


def fit(rows: DataFrame, states: int, logistic: bool = False, steps: int = 30, tolerance: float = 1e-4, prior: float = 0.0, stay: float = 0.9, chunk: int = 4096, ahead: int = 0) -> Hmm:
    """EM over rows (session, i, x array, y); x of no elements is the Gaussian model of M23. prior adds so many
    transitions in the sticky proportions (MAP). Fitting ends when the mean log-likelihood gains less than the tolerance,
    or after `steps`; the log-likelihood is that of the model returned. Each step is one pass over a table of chunks, which
    gives weighted cross products and transitions (logistic: and one for each Newton step of the weights); sums of a fixed
    size reach the driver.

    With `ahead`, linear emissions without a prior go on from the last so many steps to where those lead, once a step gains
    less than 1e-4 a row. What loses likelihood by that is dropped for the plain step, and only a plain step ends the
    fit: it ends at an optimum of the plain steps, after fewer of them; with several optima it need not be the same one.
    """
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"), F.stddev_samp("y").alias("s"), F.max("i").alias("last")).first()
    n, p, whole = told["n"], told["p"], told["last"] < chunk
    weights = np.zeros((1, states, 1 + p))
    weights[:, :, 0] = np.linspace(-1, 1, states) if logistic else list(quantiles(rows.select(F.lit(0).alias("_all"), "y"), ["_all"], "y", [(k + 0.5) / states for k in range(states)]).first())[1:]
    group = Group(states, np.array([-1]), weights, None if logistic else np.full((1, states), max(told["s"] or 1.0, 1e-6)), sticky(states, stay)[None], np.full((1, states), 1 / states))
    data = rows.select("session", "i", F.transform("x", lambda v: v.cast("double")).alias("x"), F.col("y").cast("double").alias("y"))
    before, kept, seen, guessed = -math.inf, group, [], False
    with written(packed(data, chunk, ["x"], ["y"])) as held:
        for step in range(steps + 1):
            got = sums(held, [replace(group, point=group.weights) if logistic else group], p, whole)[0][0]
            gain = got[0] - before
            if guessed and not gain >= 0:
                group, guessed, seen = plain, False, []
                continue
            before, kept = got[0], group
            if step == steps or not guessed and gain < tolerance * n:
                break
            trans = got[4 : 4 + states * states].reshape(states, states) + prior * sticky(states, stay) + 1e-9
            trans = trans / trans.sum(axis=1, keepdims=True)
            if logistic:
                weights, sd = _logistic(held, group, got, p, whole), None
            else:
                at = 4 + states * states + states
                g = got[at : at + states * (p + 2) ** 2].reshape(states, p + 2, p + 2)
                weights = np.stack([np.linalg.lstsq(x[:-1, :-1] + 1e-9 * np.eye(p + 1), x[:-1, -1], rcond=None)[0] for x in g])
                left = [x[-1, -1] - 2 * w @ x[:-1, -1] + w @ x[:-1, :-1] @ w for x, w in zip(g, weights, strict=True)]
                sd = np.sqrt(np.maximum(left, 1e-12) / np.maximum(g[:, 0, 0], 1e-12))[None]
            plain, guessed = replace(group, weights=weights[None], deviations=sd, transitions=trans[None]), False
            if ahead and not logistic and not prior:
                sizes = np.sqrt(np.diagonal(g.sum(axis=0))[:-1] / n)
                units = max(told["s"] or 1.0, 1e-6) / np.where(sizes > 0, sizes, 1)
                seen = [*seen[-ahead:], (_numbers(group, units), _numbers(plain, units))]
                guessed = len(seen) > 1 and tolerance * n <= gain < 1e-4 * n
            group = _model(plain, _onward(seen), units, 1e-9 / n) if guessed else plain
    return Hmm(kept.weights[0], None if logistic else kept.deviations[0], kept.transitions[0], float(before))


def loglik(rows: DataFrame, model: Hmm) -> float:
    """Log-likelihood of held-out rows."""
    return smooth(rows.withColumn("ll", model.levels()), model.transitions).agg(F.sum("gain")).first()[0]


def information(states: int, inputs: int, loglik: float, n: int, dimensions: int = 1) -> dict[str, float]:
    """Number of parameters, AIC and BIC."""
    k = (states + 1) * (states - 1) + states * (dimensions * inputs + 2 * dimensions)
    return {"parameters": k, "aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik}


def occupancy(smoothed: DataFrame) -> DataFrame:
    """By session and state: rows, share, mean posterior."""
    n = smoothed.groupBy("session").agg(F.count("*").alias("_n"))
    each = smoothed.groupBy("session", "state").agg(F.count("*").alias("n"), F.avg(F.get("posterior", F.col("state"))).alias("mean_posterior"))
    return each.join(n, "session").withColumn("share", F.col("n") / F.col("_n")).drop("_n")
