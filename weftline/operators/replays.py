"""Sequential values replayed over a session's history, choice rules and their scores.

Every replay runs on valid trials and emits the state before the trial.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.history import before, ordered

EPS = 1e-12


def decayed_sum(rows: DataFrame, value: Column, decay: float, out: str, *keys: str) -> DataFrame:
    """Before each row the sum of the earlier values, the latest in full and every one before it times decay once more.

    Rows are taken in chunks so long that what lies two chunks back is below a double's precision; so plain running
    sums do, scaled within a chunk, and no session is held as one array.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    size = math.ceil(37 / -math.log(decay))
    keys = keys or ("session",)
    rows = rows.withColumn("_pos", F.row_number().over(ordered(*keys)) - 1).withColumn("_v", value.cast("double"))
    rows = rows.withColumn("_chunk", F.floor(F.col("_pos") / size)).withColumn("_k", F.col("_pos") % size)
    rows = rows.withColumn("_scaled", F.col("_v") * F.pow(F.lit(1 / decay), F.col("_k")))
    inside = F.coalesce(F.sum("_scaled").over(before(*keys, "_chunk")), F.lit(0.0)) * F.pow(F.lit(decay), F.col("_k") - 1)
    rows = rows.withColumn("_in", inside)
    total = F.when(F.col("_k") == size - 1, F.col("_in") * decay + F.col("_v"))
    rows = rows.withColumn("_total", total).withColumn("_carry", F.coalesce(F.last("_total", True).over(before(*keys)), F.lit(0.0)))
    return rows.withColumn(out, F.col("_in") + F.col("_carry") * F.pow(F.lit(decay), F.col("_k"))).drop("_pos", "_v", "_chunk", "_k", "_scaled", "_in", "_total", "_carry")


def q_learning(trials: DataFrame, rate: float = 0.1) -> DataFrame:
    """the chosen side's value moves by rate towards the reward; q_value is left less right, both from 0."""
    rows = decayed_sum(trials.where("valid"), F.col("reward") * rate, 1 - rate, "_was", "session", "action")
    rows = rows.withColumn("_now", F.col("_was") * (1 - rate) + F.col("reward") * rate)
    side = lambda a: F.coalesce(F.last(F.when(F.col("action") == a, F.col("_now")), True).over(before("session")), F.lit(0.0))
    return rows.withColumn("q_left", side(1)).withColumn("q_right", side(0)).withColumn("q_value", F.col("q_left") - F.col("q_right")).drop("_was", "_now")


def forgetting_q(trials: DataFrame, decay: float = 0.9, scale: float | None = None) -> DataFrame:
    """both values decay, then the chosen side gains 1 - decay times the reward; tanh of scale times the difference if asked."""
    rows = decayed_sum(trials.where("valid"), F.col("reward") * (2 * F.col("action") - 1) * (1 - decay), decay, "fq_value")
    return rows if scale is None else rows.withColumn("fq_value", F.tanh(F.col("fq_value") * scale))


def perseveration(trials: DataFrame, rate: float = 0.5) -> DataFrame:
    """Weighted mean of the earlier choices (left 1, right -1), weights falling by exp(-rate) a trial; 0 at first."""
    a = math.exp(-rate)
    rows = decayed_sum(trials.where("valid"), 2 * F.col("action") - 1, a, "_num")
    n = F.row_number().over(ordered("session")) - 1
    return rows.withColumn("perseveration", F.coalesce(F.try_divide(F.col("_num") * (1 - a), 1 - F.pow(F.lit(a), n)), F.lit(0.0))).drop("_num")


def ordered_fold(trials: DataFrame, out: str, start: float, step: Callable[[float, int, int], float]) -> DataFrame:
    """the state before each valid trial, carried on by step(state, action, reward) in the order of a session.

    Sessions come sorted and in batches, so that a task holds one batch and one state, however long a session is.
    """
    rows = trials.where("valid").select("session", "t", "seq", "action", "reward")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, start
        for b in batches:
            seen = []
            for s, a, r in zip(b["session"], b["action"], b["reward"], strict=True):
                if s != session:
                    session, state = s, start
                seen.append(state)
                state = step(state, a, r)
            yield b.assign(**{out: seen})

    schema = f"session {rows.schema['session'].dataType.simpleString()}, t {rows.schema['t'].dataType.simpleString()}, seq bigint, action int, reward int, {out} double"
    rows = rows.withColumn("seq", F.col("seq").cast("bigint"))
    return rows.repartition("session").sortWithinPartitions("session", "t", "seq").mapInPandas(run, schema)


def _bayes(left: float, action: int, reward: int, hit: float, miss: float) -> float:
    """Belief in the left side after an outcome; hit and miss are the chances of reward on the right and on the wrong side."""
    at_left, at_right = (hit, miss) if action == 1 else (miss, hit)
    a, b = (at_left, at_right) if reward else (1 - at_left, 1 - at_right)
    return (left * a + EPS / 2) / (left * a + (1 - left) * b + EPS)


def hmm_value(trials: DataFrame, hit: float = 0.8, miss: float = 0.1, move: float = 0.05) -> DataFrame:
    """log-odds of the left side under Bayes' rule and a chance `move` of a side change after each trial."""

    def step(left: float, action: int, reward: int) -> float:
        left = _bayes(left, action, reward, hit, miss)
        return left * (1 - move) + (1 - left) * move

    return ordered_fold(trials, "p_left", 0.5, step).withColumn("hmm_value", F.log(F.col("p_left") / (1 - F.col("p_left"))))


def hmm_reward_decay(trials: DataFrame, hit: float = 0.8, miss: float = 0.1, move: float = 0.05, fade: float = 0.3, scale: float = 0.5) -> DataFrame:
    """as F03 on a reward; an omission shrinks the log-odds by fade. The value is tanh(scale * log-odds)."""

    def step(left: float, action: int, reward: int) -> float:
        left = _bayes(left, action, reward, hit, miss) if reward else 1 / (1 + math.exp(-(1 - fade) * math.log(left / (1 - left))))
        return left * (1 - move) + (1 - left) * move

    return ordered_fold(trials, "p_left", 0.5, step).withColumn("hmm_decay_value", F.tanh(scale * F.log(F.col("p_left") / (1 - F.col("p_left")))))


def expectancy(doubt: DataFrame, threshold: float = 3.0, scale: float = 1.0, w_home: float = 1.0, w_doubt: float = 1.0) -> DataFrame:
    """drive towards the side rewarded last, which turns with the rewards in a row there, and away from doubt."""
    w = before("session")
    home = F.last(F.when(F.col("reward") == 1, F.col("action")), True).over(w)
    rows = doubt.withColumn("_home", home)
    rows = rows.withColumn("_turn", ((F.col("reward") == 1) & F.coalesce(F.col("action") != F.col("_home"), F.lit(True))).cast("int"))
    rows = rows.withColumn("_turns", F.sum("_turn").over(ordered("session")))
    rows = rows.withColumn("_n", F.sum((F.col("reward") == 1).cast("int")).over(ordered("session", "_turns")))
    rows = rows.withColumn("home_rewards", F.coalesce(F.last("_n", True).over(w), F.lit(0)))
    strength = (1 + F.tanh((F.col("home_rewards") - threshold) / scale)) / 2
    pull = F.coalesce((2 * F.col("_home") - 1) * (1 - 2 * strength), F.lit(0.0))
    rows = rows.withColumn("expectancy_value", F.tanh(w_home * pull - w_doubt * F.col("doubt_value")))
    return rows.withColumn("p_left", (1 + F.col("expectancy_value")) / 2).drop("_home", "_turn", "_turns", "_n")


def choice_probability(rows: DataFrame, score: str, rule: str = "logistic", temperature: float = 1.0, error: float = 0.1) -> DataFrame:
    """p_left from a score: logistic, a fixed error for the side not preferred (0.5 at a tie), or a constant 0.5."""
    s = F.col(score)
    p = {
        "logistic": 1 / (1 + F.exp(-s / temperature)),
        "error": F.when(s > 0, 1 - error).when(s < 0, error).otherwise(0.5),
        "constant": F.lit(0.5),
    }[rule]
    return rows.withColumn("p_left", p)


def signed_to_probability(value: Column, rule: str = "linear", scale: float = 1.0) -> Column:
    """A value in [-1, 1] as a chance: half of it plus 0.5, or the logistic of atanh(value) / scale, cut at 1e-8."""
    if rule == "linear":
        return F.least(F.greatest(value / 2 + 0.5, F.lit(0.0)), F.lit(1.0))
    return 1 / (1 + F.exp(-F.atanh(F.least(F.greatest(value, F.lit(-1 + 1e-8)), F.lit(1 - 1e-8))) / scale))


def score_replay(rows: DataFrame, floor: float = 1e-6) -> DataFrame:
    """per session mean chance of the choices made, negative log likelihood, Brier score of switches, greedy agreement.

    A tie of the greedy choice counts as half; switches are those between neighbouring valid trials.
    """
    seen = F.when(F.col("action") == 1, F.col("p_left")).otherwise(1 - F.col("p_left"))
    was = F.lag("action").over(ordered("session"))
    rows = rows.withColumn("_p", seen).withColumn("_was", was)
    other = F.when(F.col("_was") == 1, 1 - F.col("p_left")).otherwise(F.col("p_left"))
    miss = F.when(F.col("_was").isNotNull(), other - (F.col("action") != F.col("_was")).cast("int"))
    agree = F.when(F.col("p_left") == 0.5, 0.5).otherwise(((F.col("p_left") > 0.5) == (F.col("action") == 1)).cast("double"))
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_probability"), F.avg(-F.log(F.greatest("_p", F.lit(floor)))).alias("nll"), F.avg(miss * miss).alias("switch_brier"), F.avg(agree).alias("agreement"))


def model_panel(doubt: DataFrame) -> DataFrame:
    """F06 in part: chance, persistence, win-stay-lose-switch, its inverse and away from doubt (as F05 has it) over one history, a row for each trial and policy."""
    same = 2 * F.lag("action").over(ordered("session")) - 1
    wsls = same * F.when(F.lag("reward").over(ordered("session")) == 1, 1).otherwise(-1)
    rows = doubt.withColumn("_same", F.coalesce(same, F.lit(0))).withColumn("_wsls", F.coalesce(wsls, F.lit(0)))
    pick = lambda name, c: F.struct(F.lit(name).alias("policy"), c.cast("double").alias("drive"))
    policies = F.array(pick("chance", F.lit(0.0)), pick("persistence", F.col("_same")), pick("wsls", F.col("_wsls")), pick("inverse_wsls", -F.col("_wsls")), pick("doubt", -F.col("doubt_value")))
    return rows.select("session", "t", "seq", "action", "reward", F.inline(policies)).withColumn("agree", F.when(F.col("drive") == 0, 0.5).otherwise(((F.col("drive") > 0) == (F.col("action") == 1)).cast("double")))
