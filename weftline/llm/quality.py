"""Operator 3: quality by positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_fold, map_texts, materialize, slices

#: The held-out rows of the contract: crc32(id) mod FOLDS is HELD_OUT.
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
MEASURES = 19

_KINDS = np.full(256, 4, np.uint8)  # of a byte: 0 lower, 1 upper, 2 digit, 3 space, 4 other ASCII, 5 beyond ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[32, *range(9, 14)]], _KINDS[128:] = 0, 1, 2, 3, 5
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*@^~<>{}[]\\/|=+_"]] = True


def measures(text: str | None, support: np.ndarray) -> list[float]:
    """Numbers about one whole text, each between 0 and about 1; the empty text has its own flag.

    support (see word_support) is by hashed word: how well the trusted positives know it.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (MEASURES - 1)
    b = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KINDS[b], minlength=6) / len(b)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    tally = np.bincount(at)
    known = float(support[_buckets(ids, len(support))] @ tally) / n
    lines = raw.splitlines()
    marks = raw.count(b"!"), raw.count(b"|"), raw.count(b","), raw.count(b".") + raw.count(b"?")
    letters = max(kinds[0] + kinds[1], 1e-9)
    length = np.fromiter(map(len, words), np.float64, n)
    return [
        0.0,
        min(1.0, np.log1p(n) / 10),
        float(n < 20),
        len(ids) / n,
        float((tally[tally > 3].sum()) / n),
        float(tally.max() / n),
        float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0,
        kinds[1] / letters,
        kinds[2],
        kinds[4],
        kinds[5],
        float(_ODD[b].mean()) * 5,
        min(1.0, marks[0] / n),
        min(1.0, marks[1] / n),
        min(1.0, (marks[2] + marks[3]) / n),
        min(1.0, length.mean() / 20),
        1 - len(set(lines)) / max(len(lines), 1),
        min(1.0, len(lines) / n * 5),
        known,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """The measures, hinges of each at a few fixed places, and an intercept."""
    hinges = [np.maximum(x - t, 0) for t in (0.02, 0.1, 0.3, 0.6)]
    return np.hstack([x, *hinges, np.ones((len(x), 1))])


def _buckets(words: Iterable[bytes], size: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64) % np.uint64(size)


@dataclass(frozen=True)
class QualityModel:
    """weights: of expand(measures); prior: the estimated share of good texts; support: by hashed word."""

    weights: np.ndarray
    prior: float
    support: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(expand(x) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def trusted(labels: DataFrame, most: int) -> DataFrame:
    """doc_id of about `most` training rows with quality 1 at most, chosen by a hash of the id; no other label is read.

    Rows outside the training fold and null ids are no part; an id that repeats is in once.
    """
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).where(~in_fold("doc_id", FOLDS, HELD_OUT)).select("doc_id").distinct()
    share = min(1.0, most / max(ids.count(), 1))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))


def word_support(docs: DataFrame, size: int = 1 << 16, half: float = 2e-4) -> np.ndarray:
    """By hashed word its share s of the words of docs as s / (s + half): near 1 for the common ones, 0 for those not met.

    docs has one column of texts. A task adds up one array of a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(size, np.int64)
        for b in batches:
            for _, texts in slices(b.column(0), 1 << 20):
                for t in texts.cast(pa.binary()).to_pylist():
                    np.add.at(tally, _buckets((t or b"").split(), size), 1)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tally[at])], ["bucket", "n"])

    out = np.zeros(size)
    for r in docs.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `size` rows at most
        out[r["bucket"]] = r["n"]
    share = out / max(out.sum(), 1)
    return (share / (share + half)).astype(np.float32)


def features(docs: DataFrame, support: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array<double>) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(support)  # of a fixed size

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            x = np.array([measures(t, shared.value) for t in texts.to_pylist()])
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * MEASURES), pa.array(x.ravel()))]

        return work

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "x array<double>", start).drop("text")


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(len(x), MEASURES)


def _added(points: DataFrame, size: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of points (x, p) of sums(matrix, p), an array of `size`: one pass of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                acc += sums(_matrix(part.column(0)), part.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(acc)], ["at", "v"])

    out = np.zeros(size)
    for r in points.select("x", "p").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def class_prior(above_u: np.ndarray, above_p: np.ndarray, n_u: float, n_p: float) -> float:
    """The share of positives among unlabelled rows, from how many of either kind score above each of many thresholds.

    If some threshold leaves positives alone above it, the share is the ratio of the two fractions there; it is taken
    where the ratio with its confidence bound (of 90 %) is least. No negative is read.
    """
    q_u, q_p = above_u / max(n_u, 1), above_p / max(n_p, 1)
    noise = 1.01 * (np.sqrt(np.log(40) / 2 / max(n_u, 1)) + np.sqrt(np.log(40) / 2 / max(n_p, 1)))
    q = np.maximum(q_p, 1e-9)
    at = int(np.argmin((q_u + noise) / q))
    return float(np.clip(q_u[at] / q[at], 0.01, 0.99))


def fit(points: DataFrame, support: np.ndarray, steps: int = 10, ridge: float = 3e-4, tolerance: float = 1e-3) -> QualityModel:
    """Weights that minimise the non-negative positive-unlabelled risk with the logistic loss, by Newton's method.

    points (x, p): p is 1 or 2 for trusted positives, 0 else, and every row counts as unlabelled. The risk is
    prior * E_pos[l(z)] + max(0, E_unl[l(-z)] - prior * E_pos[l(-z)]); a step to where the second term is negative is
    taken back by halves until it is not, and there the fit ends: that is the non-negative correction. The prior is
    estimated (class_prior) from the scores of the positives of kind 2 and of the unlabelled rows under a fit to those
    of kind 1 with prior one half; then a second fit has it and all positives. A step is one
    Spark job over every row; only sums of a fixed size reach the driver. Each fit ends when the risk changes by less
    than `tolerance` of itself, or after `steps`: the risk is that of the returned weights within what steps remained.
    """
    size = expand(np.zeros((1, MEASURES))).shape[1]
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 1e-9

    def minimise(w: np.ndarray, prior: float, kinds: tuple[int, ...]) -> np.ndarray:
        def sums(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            # n_u, n_p, losses of label -1 over u and p, gradients of these, the positives' x, the Hessian over u
            f, pos = expand(x), np.isin(p, kinds)
            z = f @ w
            s, loss = _sigmoid(z), np.logaddexp(0, z)
            return np.concatenate([[len(f), pos.sum(), loss.sum(), loss[pos].sum()], s @ f, s[pos] @ f[pos], f[pos].sum(axis=0), (f.T @ ((s * (1 - s))[:, None] * f)).ravel()])

        before, good = np.inf, None
        for _ in range(steps):
            a = _added(points, 4 + 3 * size + size * size, sums)
            n_u, n_p = max(a[0], 1), max(a[1], 1)
            loss_u, loss_p, (grad_u, _, mean_p) = a[2] / n_u, a[3] / n_p, a[4 : 4 + 3 * size].reshape(3, size) / [[n_u], [n_p], [n_p]]
            if loss_u < prior * loss_p and good is not None:
                w, before = (w + good) / 2, -np.inf
                continue
            # l(z) - l(-z) = -z, so the unbiased risk is E_unl[l(-z)] - prior * E_pos[z], which is convex in w
            risk = loss_u - prior * (mean_p @ w)
            if before == -np.inf or abs(before - risk) <= tolerance * abs(risk):
                return w
            before, good = risk, w
            step = np.linalg.solve(a[4 + 3 * size :].reshape(size, size) / n_u + penalty, grad_u - prior * mean_p + penalty @ w)
            w = w - step * min(1.0, 20.0 / max(np.linalg.norm(step), 1e-12))
        return good if before == -np.inf else w

    w = minimise(np.zeros(size), 0.5, (1,))
    places = np.linspace(0, 1, 1001)

    def above(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        s = np.sort(_sigmoid(expand(x) @ w))
        own = np.sort(_sigmoid(expand(x[p == 2]) @ w))
        return np.concatenate([[len(s), len(own)], len(s) - np.searchsorted(s, places), len(own) - np.searchsorted(own, places)])

    a = _added(points, 2 + 2 * len(places), above)
    prior = class_prior(a[2 : 2 + len(places)], a[2 + len(places) :], a[0], a[1]) if a[1] else 0.5
    return QualityModel(minimise(np.zeros(size), prior, (1, 2)), prior, support)


def quality(docs: DataFrame, labels: DataFrame, most_trusted: int = 20_000, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    At most about `most_trusted` labelled positives are learnt from (a documented bound; their ids are broadcast); the
    unlabelled rows are all of docs. Null texts score as empty ones; repeated rows are each returned with the same
    score; rows with null ids are scored and are unlabelled. An empty table gives an empty result; without positives
    the prior is one half and no word is known. Extra columns of docs are ignored.
    """
    ids = materialize(trusted(labels, most_trusted))
    support = word_support(docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text"))
    x = materialize(features(docs, support).join(F.broadcast(ids.withColumn("p", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int") + 1)), "doc_id", "left").select("doc_id", "x", F.coalesce("p", F.lit(0)).alias("p")))
    model = fit(x, support, **fitting)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(model.score(np.stack(p.to_numpy())) if len(p) else np.zeros(0))

    rows = x.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), run("x").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
