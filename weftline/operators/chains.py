"""Chances of hidden chains over chunks of rows, many chunks of a task side by side.

A table of chunks has one row for each `chunk` rows of a session, with their values as flat lists, so that passes over it
need no shuffle. A task takes whole chunks of some 65,536 rows at a time and steps through all of them together, the
longest first: a step is a few array operations over chunks and models, however short the sessions are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16


def packed(rows: DataFrame, chunk: int, lists: Sequence[str] = (), numbers: Sequence[str] = (), same: Sequence[str] = ()) -> DataFrame:
    """(session, chunk, first, ...) of rows (session, i from 0 without gaps, ...): by chunk the first i, the arrays of `lists`
    one after another, the values of `numbers`, and the columns of `same`, which a session's rows share."""
    data = rows.select("session", F.floor(F.col("i") / chunk).alias("chunk"), F.col("i").cast("bigint").alias("i"), *lists, *numbers, *same)
    # by number, so that tasks that are long for their few bytes are not put together
    data = data.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session", "chunk")
    all_of = data.groupBy("session", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", *lists, *numbers))).alias("_r"), *[F.max(c).alias(c) for c in same])
    return all_of.select("session", "chunk", F.element_at("_r.i", 1).alias("first"), *[F.flatten(F.col("_r")[c]).alias(c) for c in lists], *[F.col("_r")[c].alias(c) for c in numbers], *same)


def blocks(batch: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch of chunks, and their numbers of rows, of BLOCK rows or one chunk at most."""
    ends, at = np.cumsum(rows), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        yield batch.slice(at, to - at), rows[at:to]
        at = to


def flat(column: pa.Array) -> np.ndarray:
    """The elements of a column of lists, one after another."""
    return column.flatten().to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as a column of lists; null where `missing`."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(values).ravel()), mask=None if missing is None else pa.array(missing))


class Steps:
    """The rows of runs that lie one after another, dealt anew by their place in the run: all first rows, all second ones, and
    so on, the longest run first. `rows` names the row at each place; step t has places at[t] to at[t + 1]."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        self.runs, self.number = len(lengths), int(sizes[0])
        self.count = np.searchsorted(-sizes, -np.arange(self.number), "left")
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        t = np.repeat(np.arange(self.number), self.count)
        r = np.arange(self.at[-1]) - self.at[t]
        self.run, self.step = self.order[r], t
        self.rows = (np.cumsum(lengths) - lengths)[self.run] + t
        #: each place's row before it, where the runs' own beginnings come first
        self.before = np.where(t == 0, r, self.runs + self.at[t - 1] + r)
        self.last = self.at[sizes - 1] + np.arange(self.runs)


def through(v: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """v (model, state, row) moved on by moves (model, from, to, and row if they differ)."""
    moves = moves if moves.ndim == 4 else moves[..., None]
    out = v[:, 0, None] * moves[:, 0]
    for a in range(1, v.shape[1]):
        out += v[:, a, None] * moves[:, a]
    return out


def forward(steps: Steps, e: np.ndarray, fresh: np.ndarray, before: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the states at the runs' beginnings and after every row (model, state, runs + rows), and what each row's
    likelihoods come to; before (model, state, run) must add up to 1."""
    f, k, n = e.shape
    a, total = np.empty((f, k, steps.runs + n)), np.empty((f, n))
    a[:, :, : steps.runs] = before
    news = np.logical_or.reduceat(fresh.any(axis=0), steps.at[:-1])
    for t in range(steps.number):
        lo, hi = steps.at[t], steps.at[t + 1]
        from_ = steps.runs + steps.at[t - 1] if t else 0
        v = through(a[:, :, from_ : from_ + hi - lo], transitions)
        if news[t]:
            v = np.where(fresh[:, None, lo:hi], start[:, :, None], v)
        v *= e[:, :, lo:hi]
        total[:, lo:hi] = v.sum(axis=1)
        np.divide(v, total[:, None, lo:hi], out=a[:, :, steps.runs + lo : steps.runs + hi])
    return a, total


def backward(steps: Steps, e: np.ndarray, fresh: np.ndarray, after: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """How likely the rows after each one are by its state, up to a factor; after (model, state, run) is that of the last ones."""
    b = np.empty_like(e)
    b[:, :, steps.last] = after
    back = transitions.transpose(0, 2, 1)
    news = np.logical_or.reduceat(fresh.any(axis=0), steps.at[:-1])
    for t in range(steps.number - 1, 0, -1):
        lo, hi = steps.at[t], steps.at[t + 1]
        v = through(e[:, :, lo:hi] * b[:, :, lo:hi], back)
        v /= v.max(axis=1, keepdims=True)
        if news[t]:
            v = np.where(fresh[:, None, lo:hi], 1.0, v)
        b[:, :, steps.at[t - 1] : steps.at[t - 1] + hi - lo] = v
    return b


def products(steps: Steps, e: np.ndarray, fresh: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each run's matrix of moves (run, model, from, to), up to a factor."""
    f, k, _ = e.shape
    m = np.tile(np.eye(k)[:, :, None], (f, 1, 1, steps.runs))
    news = np.logical_or.reduceat(fresh.any(axis=0), steps.at[:-1])
    for t in range(steps.number):
        lo, hi = steps.at[t], steps.at[t + 1]
        old = m[:, :, :, : hi - lo]
        v = np.stack([through(old[:, a], transitions) for a in range(k)], axis=1)
        if news[t]:
            v = np.where(fresh[:, None, None, lo:hi], old.sum(axis=2)[:, :, None] * start[:, None, :, None], v)
        v *= e[:, None, :, lo:hi]
        v /= v.max(axis=(1, 2), keepdims=True)
        m[:, :, :, : hi - lo] = v
    out = np.empty((steps.runs, f, k, k))
    out[steps.order] = m.transpose(3, 0, 1, 2)
    return out


def ends(matrices: DataFrame, shapes: Sequence[tuple[int, int]]) -> DataFrame:
    """(session, chunk, before, after) of (session, chunk, m): the chances at the chunks' ends, of groups of (models, states)
    one after another. Whatever comes before a session's first row must not matter to it."""
    kind = dict(matrices.dtypes)["session"]
    width = sum(f * k * k for f, k in shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lengths in blocks(batch, pc.list_value_length(batch["chunk"]).to_numpy(zero_copy_only=False)):
                steps, m, at = Steps(lengths), flat(b["m"]).reshape(-1, width), 0
                before, after = [], []
                for f, k in shapes:
                    own = m[steps.rows, at : at + f * k * k].reshape(-1, f, k, k).transpose(1, 2, 3, 0)
                    at += f * k * k
                    x, y = np.full((f, k, len(m)), 1 / k), np.ones((f, k, len(m)))
                    for t in range(1, steps.number):
                        old, lo, hi = steps.at[t - 1], steps.at[t], steps.at[t + 1]
                        v = through(x[:, :, old : old + hi - lo], own[..., old : old + hi - lo])
                        x[:, :, lo:hi] = v / v.sum(axis=1, keepdims=True)
                    for t in range(steps.number - 1, 0, -1):
                        old, lo, hi = steps.at[t - 1], steps.at[t], steps.at[t + 1]
                        v = through(y[:, :, lo:hi], own[..., lo:hi].transpose(0, 2, 1, 3))
                        y[:, :, old : old + hi - lo] = v / v.max(axis=1, keepdims=True)
                    for out, z in ((before, x), (after, y)):
                        out.append(z.transpose(2, 0, 1).reshape(len(m), -1))
                yield pa.RecordBatch.from_arrays([b["session"].take(pa.array(steps.run)), pa.array(flat(b["chunk"])[steps.rows], pa.int64()), lists(np.hstack(before)), lists(np.hstack(after))], ["session", "chunk", "before", "after"])

    each = matrices.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("chunk", "m"))).alias("_r"))
    return each.select("session", F.col("_r.chunk").alias("chunk"), F.flatten("_r.m").alias("m")).mapInArrow(run, f"session {kind}, chunk bigint, before array<double>, after array<double>")


def with_ends(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The table of chunks with `before` and `after` of each; a null session is one like any other."""
    found = vectors.select(F.col("session").alias("_s"), F.col("chunk").alias("_c"), "before", "after")
    return chunks.join(found, F.col("session").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c"))).drop("_s", "_c")


@dataclass
class Group:
    """The models of one state count: out holds each one's held-out stretch, -1 for none; deviations are None for logistic
    emissions. At `point` (weights), if any, the sums hold the loss and its curvature too."""

    states: int
    out: np.ndarray
    weights: np.ndarray
    deviations: np.ndarray | None
    transitions: np.ndarray
    start: np.ndarray
    point: np.ndarray | None = None

    def part(self, keep: np.ndarray) -> Group:
        return Group(self.states, self.out[keep], self.weights[keep], None if self.deviations is None else self.deviations[keep], self.transitions[keep], self.start[keep])

    def levels(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods by model, state and row over the row's greatest one, and that one's logarithm."""
        mu = self.weights @ x.T
        if self.deviations is None:
            ll = -np.logaddexp(0, np.where(y == 1, -mu, mu))
        else:
            d = self.deviations[:, :, None]
            ll = -0.5 * ((y - mu) / d) ** 2 - np.log(d * math.sqrt(2 * math.pi))
        top = ll.max(axis=1)
        return np.exp(ll - top[:, None]), top

    def size(self, inputs: int) -> int:
        k, q = self.states, inputs + 1
        more = 0 if self.deviations is not None else k * q if self.point is None else k * (q + q * q + 1)
        return 4 + k * k + k + k * (q + 1) ** 2 + more


def _fold(i: np.ndarray, n: np.ndarray, folds: int) -> np.ndarray:
    """state_choice.stretch of rows in arrays."""
    size, more = n // folds, n % folds
    long = more * (size + 1)
    return np.where(i < long, i // (size + 1), more + (i - long) // np.maximum(size, 1))


class _Block:
    """The rows of some chunks, dealt step by step."""

    def __init__(self, b: pa.RecordBatch, lengths: np.ndarray, folds: int):
        self.steps = s = Steps(lengths)
        y = flat(b["y"]).astype(float)
        self.x = np.column_stack([np.ones(len(y)), flat(b["x"]).astype(float).reshape(len(y), -1)])[s.rows]
        self.y, self.i = y[s.rows], b["first"].to_numpy()[s.run] + s.step
        n = b["n"].to_numpy()[s.run] if folds else None
        self.fold = _fold(self.i, n, folds) if folds else np.zeros(len(y), int)
        self.last_fold = np.where(self.i > 0, _fold(np.maximum(self.i - 1, 0), n, folds), -2) if folds else self.fold

    def of(self, g: Group) -> tuple[np.ndarray, np.ndarray]:
        """By model and row whether the row is the first of its chain, and whether the model learns from it.

        The rows before a held-out stretch, the stretch, and those after it are three chains.
        """
        inside, before = g.out[:, None] == self.fold, g.out[:, None] == self.last_fold
        return (self.i == 0) | (inside != before), ~inside


def _group_sums(block: _Block, g: Group, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of each model: log-likelihood and rows learnt from, the same of the rows held out, transitions, starts, weighted
    products of (1, x, y) by state, and for logistic emissions the slope by state; at a point its curvature and loss as well."""
    steps, x, y, f, k = block.steps, block.x, block.y, len(g.out), g.states
    fresh, learn = block.of(g)
    e, top = g.levels(x, y)
    a, total = forward(steps, e, fresh, before, g.transitions, g.start)
    b = backward(steps, e, fresh, after, g.transitions)
    gain = np.log(total) + top
    post = a[:, :, steps.runs :] * b
    post *= (learn / post.sum(axis=1))[:, None]
    was, b = a[:, :, steps.before], e * b
    was *= ((learn & ~fresh) / (through(was, g.transitions) * b).sum(axis=1))[:, None]
    xi = g.transitions * (was @ b.transpose(0, 2, 1))
    z = np.column_stack([x, y])
    both = post.reshape(f * k, -1) @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
    cells = [(gain * learn).sum(axis=1)[:, None], learn.sum(axis=1)[:, None], (gain * ~learn).sum(axis=1)[:, None], (~learn).sum(axis=1)[:, None]]
    cells += [xi.reshape(f, -1), (post * fresh[:, None]).sum(axis=2), both.reshape(f, -1)]
    if g.deviations is None:
        mu = (g.weights if g.point is None else g.point) @ x.T
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-mu))
        cells.append((((y - p) * post) @ x).reshape(f, -1))
        if g.point is not None:
            curve = (p * (1 - p) * post).reshape(f * k, -1) @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            cells += [curve.reshape(f, -1), (np.logaddexp(0, np.where(y == 1, -mu, mu)) * post).sum(axis=2)]
    return np.concatenate(cells, axis=1).ravel()


def sums(chunks: DataFrame, groups: Sequence[Group], inputs: int, whole: bool, folds: int = 0) -> list[np.ndarray]:
    """The sums of _group_sums over a table of chunks (session, chunk, first, x, y, and n with folds), by group and model.

    With `whole` every session is one chunk, whose ends are known: any chances before its first row, which begins anew,
    and none to weigh after its last one.
    """
    kind = dict(chunks.dtypes)["session"]
    shapes = [(len(g.out), g.states) for g in groups]
    width = sum(f * k for f, k in shapes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Block]]:
        for batch in batches:
            for b, lengths in blocks(batch, pc.list_value_length(batch["y"]).to_numpy(zero_copy_only=False)):
                yield b, _Block(b, lengths, folds)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, block in each(batches):
            m = [products(block.steps, g.levels(block.x, block.y)[0], block.of(g)[0], g.transitions, g.start).reshape(b.num_rows, -1) for g in groups]
            yield pa.RecordBatch.from_arrays([b["session"], b["chunk"], lists(np.hstack(m))], ["session", "chunk", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b, block in each(batches):
            at, found = 0, []
            known = None if whole else [flat(b[c]).reshape(-1, width)[block.steps.order] for c in ("before", "after")]
            for g, (f, k) in zip(groups, shapes, strict=True):
                if whole:
                    v = np.full((f, k, block.steps.runs), 1 / k), np.ones((f, k, block.steps.runs))
                else:
                    v = [c[:, at : at + f * k].reshape(-1, f, k).transpose(1, 2, 0) for c in known]
                at += f * k
                found.append(_group_sums(block, g, *v))
            found = np.concatenate(found)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists(total[None])], ["v"])

    if not whole:
        chunks = with_ends(chunks, ends(chunks.mapInArrow(transfer, f"session {kind}, chunk bigint, m array<double>"), shapes))
    cells = chunks.mapInArrow(add, "v array<double>").select(F.posexplode("v").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).toPandas()
    values, out, at = cells.sort_values("p")["v"].to_numpy(), [], 0
    for g in groups:
        size = len(g.out) * g.size(inputs)
        out.append(values[at : at + size].reshape(len(g.out), -1))
        at += size
    return out
