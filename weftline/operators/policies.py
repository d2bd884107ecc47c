"""the panel of fixed policies over one observed history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.history import before, counterfactual_doubt, ordered, upto
from weftline.operators.replays import decayed_sum, hmm_reward_decay


@dataclass(frozen=True)
class PanelParameters:
    """Fixed values of the panel's policies."""

    doubt_rate: float = 0.5
    expectancy: tuple[float, float] = (3.0, 1.0)  # threshold, scale
    direct: tuple[float, float] = (2.5, 0.5)
    shared: tuple[float, float] = (2.0, 0.5)
    home: tuple[float, float] = (2.5, 0.5)
    switch_chance: tuple[float, float] = (0.1, 0.8)  # least, span
    doubt_weight: float = 1.4
    probe_weight: float = 2.0
    reward_decay: float = 0.8
    q_decay: float = 0.7
    q_rate: float = 0.3
    error: float = 0.1


def home_states(trials: DataFrame) -> DataFrame:
    """Before each valid trial: home (the side rewarded last, null at first), home_rewards (rewards there since home changed or
    was left), away (choices off home just made, without reward), run_rewards (rewards in a row of the side rewarded last),
    same (the last choice, left 1, right -1, 0 at first) and paid (its reward)."""
    w, was = ordered(), before()
    rows = trials.where("valid").withColumn("_home", F.last(F.when(F.col("reward") == 1, F.col("action")), True).over(upto()))  # after the trial
    rows = rows.withColumn("_prior", F.lag("_home").over(w))
    off = F.coalesce(F.col("action") != F.col("_home"), F.lit(False))
    turn = (F.col("reward") == 1) & F.coalesce(F.col("_prior") != F.col("action"), F.lit(True))
    rows = rows.withColumn("_off", off.cast("int")).withColumn("_turn", turn.cast("int"))
    rows = rows.withColumn("_seg", F.sum(F.greatest("_off", "_turn")).over(upto())).withColumn("_n", F.sum("reward").over(upto("session", "_seg")))
    rows = rows.withColumn("_in", F.sum(1 - F.col("_off")).over(upto())).withColumn("_away", F.sum("_off").over(upto("session", "_in")))
    rows = rows.withColumn("_turns", F.sum("_turn").over(upto())).withColumn("_run", F.sum("reward").over(upto("session", "_turns")))
    rows = rows.withColumn("home", F.col("_prior")).withColumn("home_rewards", F.coalesce(F.lag("_n").over(w), F.lit(0))).withColumn("away", F.coalesce(F.lag("_away").over(w), F.lit(0)))
    rows = rows.withColumn("run_rewards", F.coalesce(F.last(F.when(F.col("reward") == 1, F.col("_run")), True).over(was), F.lit(0)))
    rows = rows.withColumn("same", F.coalesce(2 * F.lag("action").over(w) - 1, F.lit(0))).withColumn("paid", F.coalesce(F.lag("reward").over(w), F.lit(0)))
    return rows.drop("_home", "_prior", "_off", "_turn", "_seg", "_n", "_in", "_away", "_turns", "_run")


def _strength(n: Column, curve: tuple[float, float]) -> Column:
    return (1 + F.tanh((n - curve[0]) / curve[1])) / 2


def policy_panel(trials: DataFrame, p: PanelParameters = PanelParameters()) -> DataFrame:
    """a row per valid trial and policy with p_left, the chance of left before the trial; only the observed history is read.

    chance, immediate persistence, win-stay-lose-shift and its mirror, probe and persistence (with and without doubt),
    expectancy with persistence and doubt, expected switches by own or shared rewards, home-referenced expectancy, decayed
    observer, forgetting Q, and thresholds of 3 and 1 rewards to probe and omissions to return.
    """
    key = ["session", "t", "seq"]
    rows = home_states(trials).join(counterfactual_doubt(trials, p.doubt_rate).select(*key, "doubt_value"), key)
    rows = decayed_sum(rows, F.col("reward"), p.reward_decay, "pooled")
    rows = decayed_sum(rows, F.col("reward") * (2 * F.col("action") - 1) * p.q_rate, p.q_decay, "fq")
    rows = rows.join(hmm_reward_decay(trials).select(*key, F.col("hmm_decay_value").alias("belief")), key)
    same, paid, doubt = F.col("same"), F.col("paid"), -F.col("doubt_value")
    probe = -same * paid
    half = lambda drive: (1 + F.tanh(drive)) / 2
    value = lambda v: (1 + v) / 2
    side = F.coalesce(2 * F.col("home") - 1, F.lit(0))

    def expected(strength: Column) -> Column:
        chance = p.switch_chance[0] + p.switch_chance[1] * strength
        after = F.when(paid > 0, F.when(same < 0, chance).otherwise(1 - chance)).otherwise(half(same + p.doubt_weight * doubt))
        return F.when(same == 0, 0.5).otherwise(after)

    def threshold(n: int) -> Column:
        out = F.col("away") > 0
        goal = F.when(out, F.when(F.col("away") < n, 1 - F.col("home")).otherwise(F.col("home"))).when((paid > 0) & (F.col("home_rewards") >= n), 1 - F.col("home")).otherwise(F.col("home"))
        return F.when(F.col("home").isNull(), 0.5).when(goal == 1, 1 - p.error).otherwise(p.error)

    found = {
        "chance": F.lit(0.5), "immediate_persistence": value(same), "wsls": value(F.when(paid > 0, same).otherwise(-same)), "win_switch_lose_stay": value(F.when(paid > 0, -same).otherwise(same)),
        "simple_probe_persistence": half(same + probe), "expectancy_persistence_doubt": half(same + probe * _strength(F.col("run_rewards"), p.expectancy) + doubt),
        "history_ideal_observer": value((F.col("belief") + doubt) / 2), "forgetting_q_learning": 1 / (1 + F.exp(-F.col("fq"))), "probe_persistence_doubt": half(same + p.probe_weight * probe + p.doubt_weight * doubt),
        "direct_expectancy_switch_doubt": expected(_strength(F.col("run_rewards"), p.direct)), "global_reward_expectancy_doubt": expected(_strength(F.col("pooled"), p.shared)),
        "home_referenced_expectancy_doubt": half(side * (1 - 2 * _strength(F.col("run_rewards"), p.home)) + doubt), "threshold_probe_return_3_3": threshold(3), "threshold_probe_return_1_1": threshold(1),
    }
    each = F.array(*[F.struct(F.lit(name).alias("policy"), c.cast("double").alias("p_left")) for name, c in found.items()])
    return rows.select(*key, "action", "reward", F.inline(each))


def observer_panel(panel: DataFrame) -> DataFrame:
    """per session and policy: mean chance of the choices made, agreement (ties half), and trials."""
    seen = F.when(F.col("action") == 1, F.col("p_left")).otherwise(1 - F.col("p_left"))
    agree = F.when(F.col("p_left") == 0.5, 0.5).otherwise(((F.col("p_left") > 0.5) == (F.col("action") == 1)).cast("double"))
    return panel.groupBy("session", "policy").agg(F.count("*").alias("n"), F.avg(seen).alias("mean_probability"), F.avg(agree).alias("agreement"))
