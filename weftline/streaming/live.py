"""Counters and trials of a live stream, by keyed state."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.sources.scratch import shared_folder


def run_to_end(stream: DataFrame) -> DataFrame:
    """Processes what the source has now into Parquet in the shared folder, and reads it back."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _keyed(stream: DataFrame, out: str, state: str, zero: tuple, step: Callable[[list, tuple], Iterator[tuple]], idle_ms: int | None = None, finish: Callable[[list], Iterator[tuple]] | None = None) -> DataFrame:
    """Feeds each session's rows (t long, seq long, ...) of a micro-batch, by (t, seq), to step(state, row), which changes the
    state and yields rows of `out` without the session. State ends with t and seq of the last row and the late ones; a
    row that is not after the last one is late: it is counted and dropped. With idle_ms a session from which no row has come
    for so long ends: finish(state) yields its last rows and the state goes."""
    columns = [c for c in stream.columns if c != "session"]
    names = [f.strip().split()[0] for f in out.split(",")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = list(held.get) if held.exists else [*zero, -(1 << 62), -(1 << 62), 0]
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([(key[0], *x) for x in finish(now)] if finish else [], columns=names)
            return
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])[columns]
        found = []
        for row in rows.itertuples(index=False):
            if (row.t, row.seq) <= (now[-3], now[-2]):
                now[-1] += 1
                continue
            now[-3], now[-2] = int(row.t), int(row.seq)
            found += [(key[0], *x) for x in step(now, row)]
        held.update(tuple(now))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(found, columns=names)

    full = f"{state}, last_t long, last_seq long, n_late long"
    return stream.groupBy("session").applyInPandasWithState(update, out, full, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def live_counters(trials: DataFrame) -> DataFrame:
    """C01 to C03 before each arriving valid trial (session, t long, seq long, reward 0/1), and the late rows so far.

    Same figures as over the whole table while rows come in order. The rows of one session in one micro-batch are held
    together; the source's limit of rows or files for a batch bounds them.
    """

    def step(s: list, row: tuple) -> Iterator[tuple]:
        yield int(row.seq), *s[:5], -s[4], s[-1]
        paid, was = row.reward == 1, s[5] == 1
        s[0], s[1] = (s[0] + 1, 0) if paid else (0, s[1] + 1)
        if paid:
            s[2] = (s[2] if was else 0) + 1
        else:
            s[3] = (0 if was else s[3]) + 1
        s[4] += -1 if paid else 1
        s[5] = int(paid)

    counters = "consecutive_rewards long, consecutive_omissions long, renewal_rewards long, renewal_omissions long, negative_value long"
    return _keyed(trials.select("session", "t", "seq", "reward"), f"session long, seq long, {counters}, value long, n_late long", f"{counters}, was long", (0,) * 6, step)


def live_doubt(trials: DataFrame, rate: float = 0.5) -> DataFrame:
    """C04 and C05 before each arriving valid trial (session, t long, seq long, action 0/1, reward 0/1): omissions by side
    since the side's, and since any, last reward, the doubt value, and the late rows so far."""

    def step(s: list, row: tuple) -> Iterator[tuple]:
        yield int(row.seq), *s[:4], math.exp(-rate * s[3]) - math.exp(-rate * s[2]), s[-1]
        side = 0 if row.action == 1 else 1
        if row.reward == 1:
            s[side] = s[2] = s[3] = 0
        else:
            s[side] += 1
            s[2 + side] += 1

    counters = "omissions_left long, omissions_right long, doubt_left long, doubt_right long"
    return _keyed(trials.select("session", "t", "seq", "action", "reward"), f"session long, seq long, {counters}, doubt_value double, n_late long", counters, (0,) * 4, step)


def live_trials(log: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Trials of a live log (session, t long, seq long, event, note), each as it is closed by the next trial_start: trial,
    block, side, n_outcomes, the first outcome ('unknown' where there is none), its note, and the late rows so far. An open
    last trial waits; with idle_ms it is closed, and its session's state dropped, when no row has come for so long."""

    def closed(s: list) -> Iterator[tuple]:
        if s[0]:
            yield s[0], s[3], None if s[4] < 0 else s[4], s[5], s[6] or "unknown", s[7] or None, s[-1]

    def step(s: list, row: tuple) -> Iterator[tuple]:
        trial, blocks, side = s[0], s[1], s[2]
        if row.event == "trial_start":
            yield from closed(s)
            s[0], s[3], s[4], s[5], s[6], s[7] = trial + 1, blocks, side, 0, "", ""
        elif row.event in ("enter_left_patch", "enter_right_patch"):
            s[1], s[2] = blocks + 1, int(row.event == "enter_left_patch")
        elif trial and row.event and (row.event.startswith(("correct_choice_", "wrong_choice_")) or row.event == "invalid_switch"):
            if not s[5]:
                s[6], s[7] = row.event, row.note or ""
            s[5] += 1

    state = "trial long, blocks long, side long, block long, trial_side long, n_outcomes long, outcome string, note string"
    out = "session long, trial long, block long, side long, n_outcomes long, outcome string, note string, n_late long"
    return _keyed(log.select("session", "t", "seq", "event", "note"), out, state, (0, 0, -1, 0, -1, 0, "", ""), step, idle_ms, closed)
