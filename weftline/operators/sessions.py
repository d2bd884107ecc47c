"""Whole tables of blocks and sessions, their trial-by-trial detail, sided walks, switch statistics, dated series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import features as fe
from weftline.operators import history as hi
from weftline.operators import summaries as su
from weftline.operators.history import before, ordered, upto, with_runs
from weftline.operators.linear import gram, solve

BLOCK = ["session", "block_run"]


def block_table(trials: DataFrame, value: str | None = None, latency: str | None = None) -> DataFrame:
    """Blocks with switches, right choices, the preceding block's figures, agreement with a value's greedy choices, and latencies.

    `value` is a left-positive column of trials; `latency` a column of seconds, whose mean, median and sample deviation
    over valid choices are added. The first block's preceding counts are 0 and its length and reward fraction null.
    prev_consecutive_* are the counters that stand before the block's first valid choice (null without one).
    """
    own = su.blocks(trials)
    rows = with_runs(trials, "block", "block_run")
    hit = F.col("valid") & (F.col("correct") == 1)
    extra = [F.count_if(hit).alias("n_correct"), F.avg(F.when(F.col("valid"), F.col("correct"))).alias("accuracy")]
    if latency:
        x = F.when(F.col("valid"), F.col(latency))
        extra += [F.avg(x).alias("mean_latency"), F.percentile(x, F.lit(0.5)).alias("median_latency"), F.stddev_samp(x).alias("sd_latency")]
    counts = rows.groupBy(*BLOCK).agg(*extra)
    switches = su.block_switches(trials).select(*BLOCK, F.col("switches").alias("n_switches"), F.col("switch_rate").alias("normalized_switches"))
    counters = with_runs(trials, "block", "block_run").select("session", "t", "seq", "block_run").join(hi.reward_counters(trials).select("session", "t", "seq", "consecutive_rewards", "renewal_rewards"), ["session", "t", "seq"])
    at = F.struct("t", "seq")
    start = counters.groupBy(*BLOCK).agg(F.min_by("consecutive_rewards", at).alias("_c"), F.min_by("renewal_rewards", at).alias("_m"))
    out = own.join(counts, BLOCK).join(switches, BLOCK).join(start, BLOCK, "left")
    if value:
        greedy = hi.greedy_choices(trials.where("valid"), value)
        agree = with_runs(trials, "block", "block_run").select("session", "t", "seq", "block_run").join(greedy.select("session", "t", "seq", (F.col("greedy") == F.col("action")).cast("int").alias("_g")), ["session", "t", "seq"])
        out = out.join(agree.groupBy(*BLOCK).agg(F.avg("_g").alias("agreement")), BLOCK, "left")
    w = Window.partitionBy("session").orderBy("block_run")
    first = F.row_number().over(w) == 1
    out = out.withColumn("prev_n_correct", F.coalesce(F.lag("n_correct").over(w), F.lit(0)))
    out = out.withColumn("prev_reward_fraction", F.lag(F.try_divide(F.col("n_rewarded").cast("double"), F.col("n_valid"))).over(w))
    out = out.withColumn("prev_consecutive_rewards", F.when(first, 0).otherwise(F.col("_c"))).withColumn("prev_consecutive_rewards_memory", F.when(first, 0).otherwise(F.col("_m"))).drop("_c", "_m")
    return out.withColumn("n_after_first", F.when(F.col("trials_to_correct").isNotNull(), F.col("n_valid") - F.col("trials_to_correct"))).withColumn("confusion_flag", F.col("n_switches") > 3)


def transition_streaks(trials: DataFrame) -> DataFrame:
    """Unrewarded choices in a row before each block's first right one, over all valid choices of the session; null without one."""
    rows = with_runs(trials, "block", "block_run").where("valid").withColumn("_n", F.row_number().over(ordered()))
    rows = rows.withColumn("_paid", F.coalesce(F.max(F.when(F.col("reward") == 1, F.col("_n"))).over(before()), F.lit(0)))
    return rows.groupBy(*BLOCK).agg(F.min_by(F.col("_n") - 1 - F.col("_paid"), F.when(F.col("correct") == 1, F.col("_n"))).alias("streak"))


def bias_flags(per_block: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Whether a block's bias by rewards, and by the inference of four trials, is over the threshold; null where the bias is."""
    return per_block.withColumn("rl_biased", F.col("bias_rl") > threshold).withColumn("inf_biased", F.col("bias_inf") > threshold)


def session_summary(trials: DataFrame, p_active: str, value: str) -> DataFrame:
    """One row per session: accuracy by side, trials to correct, first-try and quality shares, oracle figures, switching
    after rewards, the greedy policy of `value` (F13) and side bias. The parts are aggregates by session, so that their
    joins move one row a session.
    """
    keep = trials.where("valid")
    side = lambda s: F.avg(F.when(F.col("state") == s, F.col("correct")))
    percent = keep.groupBy("session").agg(F.count("*").alias("n_valid"), side(1).alias("left_correct"), side(0).alias("right_correct"), F.avg("correct").alias("overall_correct"))
    per = block_table(trials, value)
    ttc = fe.ttc_summary(per)
    later = F.when(F.col("block_run") > 1, F.col("trials_to_correct"))
    share = lambda good, x: F.avg(F.when(x.isNotNull(), good.cast("double")))
    t, after, agree = F.col("trials_to_correct"), F.col("accuracy_from_first"), F.col("agreement")
    quality = per.groupBy("session").agg(
        F.count("*").alias("n_blocks"), share(later == 0, later).alias("zero_ttc_fraction"), F.percentile(t, F.lit(0.5)).alias("median_ttc"), F.percentile(t, F.lit(0.75)).alias("q3_ttc"),
        share(t > 5, t).alias("frac_ttc_gt_5"), share(after < 0.7, after).alias("frac_after_lt_07"), share(agree < 0.6, agree).alias("frac_agreement_lt_06"),
        F.percentile(after, F.lit(0.5)).alias("median_after"), F.percentile(after, F.lit(0.25)).alias("q1_after"),
    )
    oracle = fe.oracle_summary(trials, p_active).select("session", "collected", "expected", F.col("fraction").alias("oracle_fraction"), F.col("difference").alias("oracle_difference"))
    excursion = hi.rewarded_choice_switching(trials).select("session", F.col("probability").alias("p_switch_after_reward"))
    policy = policy_summary(trials, p_active, value).drop("n")
    bias = su.side_bias(trials).select("session", "left_ratio", "signed_bias")
    out = percent
    for part in (ttc, quality, oracle, excursion, policy, bias):
        out = out.join(part, "session", "left")
    return out


def policy_summary(trials: DataFrame, p_active: str, value: str, p_inactive: Column | None = None) -> DataFrame:
    """per session, the greedy policy of `value` over valid choices: its accuracy, agreement with the actions and expected reward, and the reward collected beside it."""
    rows = hi.greedy_choices(trials.where(F.col("valid") & F.col(value).isNotNull()), value)
    right = F.col("greedy") == F.col("state")
    expected = F.sum(F.when(right, F.col(p_active)).otherwise(F.lit(0.0) if p_inactive is None else p_inactive))
    out = rows.groupBy("session").agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("policy_accuracy"), F.avg((F.col("greedy") == F.col("action")).cast("int")).alias("policy_agreement"), expected.alias("policy_expected"), F.sum("reward").alias("_got"))
    out = out.withColumn("policy_fraction", F.when(F.col("policy_expected") > 0, F.col("_got") / F.col("policy_expected")))
    return out.withColumn("policy_difference", F.col("_got") - F.col("policy_expected")).drop("_got")


def value_quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and quartiles of a column of replay rows by key."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"))


def persistence_detail(trials: DataFrame) -> DataFrame:
    """Every row of the blocks whose side differs from the preceding block's: status (stay, switch, post_switch,
    no_choice), places, and why the block is left out of summaries (null where it counts).

    The first switch is the first row on the new side; a block without one, with a row without a choice or with a manual
    reward before it is left out, by the first of these causes. A block's side is taken along in the same ordered pass.
    """
    rows = with_runs(trials, "block", "block_run").withColumn("_prev", F.lag("state").over(ordered()))
    w, whole = ordered(*BLOCK), Window.partitionBy(*BLOCK)
    rows = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("side", F.first("state").over(w))
    # the preceding block's side is that of its first row: constant in a block here, so the row just before this block has it
    rows = rows.withColumn("was", F.first("_prev").over(w)).where("was IS NOT NULL AND was != side")
    rows = rows.withColumn("first", F.min(F.when(F.col("action") == F.col("side"), F.col("pos"))).over(whole))
    ahead = F.col("pos") < F.col("first")
    rows = rows.withColumn("_none", F.max((ahead & F.col("action").isNull()).cast("int")).over(whole)).withColumn("_manual", F.max((ahead & (F.coalesce("manual", F.lit(1)) != 0)).cast("int")).over(whole))
    reason = F.when(F.col("first").isNull(), "no_switch_before_block_end").when(F.col("_none") == 1, "no_choice_before_switch").when(F.col("_manual") == 1, "experimenter_reward_before_switch")
    status = F.when(F.col("action").isNull(), "no_choice").when(F.col("pos") > F.col("first"), "post_switch").when(F.col("action") == F.col("was"), "stay").otherwise("switch")
    choice = F.when(F.col("action").isNotNull(), F.count("action").over(upto(*BLOCK)))
    rows = rows.withColumn("status", status).withColumn("reason", reason).withColumn("choice_after_switch", choice)
    direction = F.when(F.col("side") == 1, "right_to_left").otherwise("left_to_right")
    return rows.select("session", "seq", "block_run", (F.col("pos") + 1).alias("trial_after_switch"), "choice_after_switch", direction.alias("direction"), "status", "reason", (F.col("reason").isNull() & F.col("status").isin("stay", "switch")).alias("counted"))


def first_correct_detail(trials: DataFrame) -> DataFrame:
    """Every row from a block's first right valid choice on, with its index; only valid choices advance the index, and others have none."""
    rows = with_runs(trials, "block", "block_run")
    hit = (F.col("valid") & (F.col("correct") == 1)).cast("int")
    rows = rows.withColumn("_seen", F.max(hit).over(upto(*BLOCK))).where("_seen = 1")
    place = F.sum(F.col("valid").cast("int")).over(upto(*BLOCK)) - 1
    return rows.select("session", "seq", "block_run", "state", F.when(F.col("valid"), place).alias("ix"), F.when(F.col("valid"), F.col("correct")).alias("correct"), F.when(~F.col("valid"), "not_a_valid_choice").alias("reason"))


def window_sessions(values: DataFrame, size: int = 10) -> DataFrame:
    """Per session over full windows: how many, quartiles of agreement, and agreement pooled over their trials."""
    win = su.choice_windows(values, size)
    p = lambda q: F.percentile("agreement", F.lit(q))
    return win.groupBy("session").agg(F.count("*").alias("n"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.avg("agreement").alias("pooled"))


def dated_series(sessions: DataFrame, mouse: str, date: str, metric: str) -> DataFrame:
    """The sessions of each mouse numbered from 1 by date, with the metric as a number (null where it is none)."""
    w = Window.partitionBy(mouse).orderBy(date)
    return sessions.select(mouse, date, F.row_number().over(w).alias("number"), F.col(metric).cast("string").try_cast("double").alias(metric))


def cohort_by_day(sessions: DataFrame, mouse: str, keys: list[str], metric: str) -> DataFrame:
    """By key the mean of a metric with every mouse counting the same; a mouse that a key has twice fails the job."""
    one = sessions.groupBy(*keys, mouse).agg(F.count("*").alias("_n"), F.first(metric).alias("_m"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one row of "), F.col(mouse).cast("string"))).cast("double")).otherwise(F.col("_m").cast("double"))
    return one.withColumn("_m", once).groupBy(*keys).agg(F.count("_m").alias("n"), F.avg("_m").alias("mean"))


def centred(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """A column less its mean by key: sessions, or mice over all their sessions."""
    mean = F.avg(column).over(Window.partitionBy(*keys))
    return rows.withColumn("centred", F.col(column) - mean)


def metric_by_count(rows: DataFrame, count: str, metric: str, over: int = 20) -> DataFrame:
    """N, mean, sample deviation and standard error of a metric by a counter's value, for values with over `over` rows."""
    out = rows.groupBy(count).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    return out.where(F.col("n") > over).withColumn("sem", F.col("sd") / F.sqrt("n"))


def switch_counters(trials: DataFrame) -> DataFrame:
    """The counters that stand where the action, or the state, of valid choices changes: a row for each change and kind."""
    w = ordered()
    rows = hi.reward_counters(trials).withColumn("_a", F.lag("action").over(w)).withColumn("_s", F.lag("state").over(w))
    kinds = F.array_compact(F.array(F.when(F.col("_a") != F.col("action"), F.lit("action")), F.when(F.col("_s") != F.col("state"), F.lit("state"))))
    return rows.select("session", "seq", F.explode(kinds).alias("kind"), "consecutive_rewards", "consecutive_omissions")


def sided_walk(trials: DataFrame, counterfactual: bool = False, monotonic: bool = False) -> DataFrame:
    """Left and right value before each valid trial. A side's reward adds 1 to it, its omission takes 1 (not where
    monotonic), never below 0; where counterfactual, a reward also sets the other side to 0.

    A walk with a floor is its running sum less the least running sum so far (or 0), within the segments that resets begin.
    """
    rows = trials.where("valid")
    for name, side in (("left", 1), ("right", 0)):
        mine, paid = F.col("action") == side, F.col("reward") == 1
        step = F.when(mine & paid, 1).when(mine & F.lit(not monotonic), -1).otherwise(0)
        reset = (~mine & paid & F.lit(counterfactual)).cast("int")
        rows = rows.withColumn("_seg", F.sum(reset).over(upto())).withColumn("_s", F.sum(step).over(upto("session", "_seg")))
        rows = rows.withColumn("_after", F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto("session", "_seg"))))
        rows = rows.withColumn(f"value_{name}", F.coalesce(F.lag("_after").over(ordered()), F.lit(0))).drop("_seg", "_s", "_after")
    return rows.withColumn("value_difference", F.col("value_left") - F.col("value_right"))


def decision_variables(trials: DataFrame) -> DataFrame:
    """All counters (C01 to C05, three sided walks, side differences) before every trial; a trial that is no valid
    choice has the state that stands and leaves it as it is."""
    key = ["session", "t", "seq"]
    out = hi.reward_counters(trials).select(*key, "consecutive_rewards", "consecutive_omissions", "renewal_rewards", "renewal_omissions", "negative_value")
    out = out.join(hi.sided_values(trials).select(*key, "omissions_left", "omissions_right", (F.col("omissions_left") - F.col("omissions_right")).alias("omissions_difference")), key)
    out = out.join(hi.counterfactual_doubt(trials).select(*key, "doubt_left", "doubt_right", "doubt_value"), key)
    for name, how in (("choice", {}), ("counterfactual", {"counterfactual": True}), ("monotonic", {"counterfactual": True, "monotonic": True})):
        out = out.join(sided_walk(trials, **how).select(*key, *[F.col(f"value_{s}").alias(f"{name}_{s}") for s in ("left", "right", "difference")]), key)
    names = [c for c in out.columns if c not in key]
    after = _end_states(trials, names)
    rows = trials.select(*key, "valid").join(out, key, "left")
    w = ordered().rowsBetween(0, Window.unboundedFollowing)
    rows = rows.join(after, "session", "left")
    return rows.select(*key, *[F.coalesce(F.first(c, True).over(w), F.col(f"_end_{c}")).alias(c) for c in names])


def _end_states(trials: DataFrame, names: list[str]) -> DataFrame:
    """The counters after each session's last valid trial, for rows that no valid trial follows: those before one more, made-up trial."""
    end = trials.groupBy("session").agg(F.max("t").alias("t")).select("session", "t", F.lit((1 << 63) - 1).alias("seq"), F.lit(0).alias("action"), F.lit(0).alias("reward"), F.lit(True).alias("valid"))
    rows = trials.select("session", "t", "seq", "action", "reward", "valid").unionByName(end)
    only = lambda df: df.where(F.col("seq") == (1 << 63) - 1)
    out = only(hi.reward_counters(rows)).select("session", "consecutive_rewards", "consecutive_omissions", "renewal_rewards", "renewal_omissions", "negative_value")
    out = out.join(only(hi.sided_values(rows)).select("session", "omissions_left", "omissions_right", (F.col("omissions_left") - F.col("omissions_right")).alias("omissions_difference")), "session")
    out = out.join(only(hi.counterfactual_doubt(rows)).select("session", "doubt_left", "doubt_right", "doubt_value"), "session")
    for name, how in (("choice", {}), ("counterfactual", {"counterfactual": True}), ("monotonic", {"counterfactual": True, "monotonic": True})):
        out = out.join(only(sided_walk(rows, **how)).select("session", *[F.col(f"value_{s}").alias(f"{name}_{s}") for s in ("left", "right", "difference")]), "session")
    return out.select("session", *[F.col(c).alias(f"_end_{c}") for c in names])


def signed_omissions(trials: DataFrame) -> DataFrame:
    """Omissions in a row before each valid trial, positive when the last choice was left, negative when right."""
    rows = hi.reward_counters(trials)
    sign = 2 * F.coalesce(F.lag("action").over(ordered()), F.lit(0)) - 1
    return rows.withColumn("signed_omissions", F.col("consecutive_omissions") * sign)


def p_values(rows: DataFrame, t: str, freedom: str, name: str = "p") -> DataFrame:
    """Two-sided p of a t statistic with its degrees of freedom, by the continued fraction of the incomplete beta function; null without either."""

    @F.pandas_udf("double")
    def run(ts: pd.Series, fs: pd.Series) -> pd.Series:
        ok = ts.notna() & fs.notna() & (fs > 0)
        f, x2 = fs[ok].to_numpy(float), ts[ok].to_numpy(float) ** 2
        x = f / (f + x2)
        swap = x > (f / 2 + 1) / (f / 2 + 2.5)
        a, b, z = np.where(swap, 0.5, f / 2), np.where(swap, f / 2, 0.5), np.where(swap, 1 - x, x)
        c, d = np.ones_like(z), 1 / _off_zero(1 - (a + b) * z / (a + 1))
        h = d.copy()
        for m in range(1, 200):
            for n in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / _off_zero(1 + n * d), _off_zero(1 + n / c)
                h *= c * d
        lg = np.vectorize(math.lgamma, otypes=[float])
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(np.maximum(z, 1e-300)) + b * np.log(np.maximum(1 - z, 1e-300)))
        part = front * h / a
        out = pd.Series(np.nan, index=ts.index, dtype=float)
        out[ok] = np.where(swap, 1 - part, part)
        return out.where(ok, None)

    return rows.withColumn(name, run(F.col(t).cast("double"), F.col(freedom).cast("double")))


def _off_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def regression_table(per_block: DataFrame) -> DataFrame:
    """The line of trials_to_correct on the preceding rewards by session, with t and p of its slope; null where the line is exact or n is under 3."""
    lines = su.session_regression(per_block)
    lines = lines.withColumn("freedom", F.col("n") - 2).withColumn("t", F.when((F.col("r2") < 1) & (F.col("n") > 2), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))))
    return p_values(lines, "t", "freedom").drop("freedom")


def residualize_many(rows: DataFrame, target: str, controls: list[str]) -> DataFrame:
    """What the least-squares plane of several controls (with intercept, over all rows that have everything) leaves of the target; null elsewhere."""
    vector = F.array(*[F.col(c).cast("double") for c in controls], F.col(target).cast("double"))
    g = gram(rows.select(vector.alias("_x")), "_x").get(0)
    if g is None:
        return rows.withColumn("residual", F.lit(None).cast("double"))
    w = solve(g, list(range(len(controls))), [len(controls)])[:, 0]
    fitted = F.lit(float(w[0]))
    for c, k in zip(controls, w[1:], strict=True):
        fitted = fitted + float(k) * F.col(c)
    return rows.withColumn("residual", F.col(target) - fitted)


def stack_tables(tables: dict[str, DataFrame], name: str = "session_ID") -> DataFrame:
    """The rows of several tables with the table's id; a column that one lacks is null there."""
    out = None
    for key, df in tables.items():
        own = df.withColumn(name, F.lit(key))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def context_order(log: DataFrame, trials: DataFrame) -> DataFrame:
    """Places where a session's logged context entries (session, t, seq, side) and its blocks' sides differ, or one has no partner."""
    w = Window.partitionBy("session").orderBy("t", "seq")
    logged = log.select("session", (F.row_number().over(w)).alias("block_run"), F.col("side").alias("logged"))
    blocks = with_runs(trials, "block", "block_run").groupBy(*BLOCK).agg(F.min_by("state", F.struct("t", "seq")).alias("state"))
    return logged.join(blocks, BLOCK, "full").where(~F.col("logged").eqNullSafe(F.col("state")))


def sample_rows(rows: DataFrame, n: int, row_id: str, seed: int = 17) -> DataFrame:
    """N rows in the order of a hash of their id: the same ones at every run."""
    return rows.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id).limit(n)
