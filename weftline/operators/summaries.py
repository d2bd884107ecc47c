"""Block, session and cohort aggregation of trial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.history import before, ordered, reward_counters, upto, with_runs
from weftline.operators.ranks import quantiles


def blocks(trials: DataFrame) -> DataFrame:
    """A row for each contiguous block run, with the preceding block's figures.

    trials_to_correct is the place (from 0) of the first correct valid choice among the valid ones, null if none.
    accuracy_from_first takes the first correct choice in, accuracy_after only what follows it;
    prev_n_valid counts the preceding block's valid choices, prev_n_trials all its rows.
    """
    rows = with_runs(trials, "block", "block_run")
    place = F.sum(F.col("valid").cast("int")).over(upto("session", "block_run")) - 1
    rows = rows.withColumn("pos", F.when(F.col("valid"), place))
    hit = F.col("valid") & (F.col("correct") == 1)
    rows = rows.withColumn("ttc", F.min(F.when(hit, F.col("pos"))).over(Window.partitionBy("session", "block_run")))
    after = F.col("valid") & (F.col("pos") > F.col("ttc"))
    out = rows.groupBy("session", "block_run").agg(
        F.first("state").alias("state"), F.count("*").alias("n_trials"), F.count_if("valid").alias("n_valid"), F.first("ttc").alias("trials_to_correct"),
        F.avg(F.when(after, F.col("correct"))).alias("accuracy_after"),
        F.avg(F.when(F.col("valid") & (F.col("pos") >= F.col("ttc")), F.col("correct"))).alias("accuracy_from_first"), F.sum(F.when(F.col("valid"), F.col("reward")).otherwise(0)).alias("n_rewarded"),
    )
    w = Window.partitionBy("session").orderBy("block_run")
    out = out.withColumn("prev_n_rewarded", F.coalesce(F.lag("n_rewarded").over(w), F.lit(0))).withColumn("prev_n_trials", F.lag("n_trials").over(w)).withColumn("prev_n_valid", F.lag("n_valid").over(w))
    t, p = F.col("trials_to_correct"), F.col("prev_n_rewarded")
    out = out.withColumn("bias_rl", (t - p) / (t + p + F.lit(1e-9))).withColumn("bias_inf", (t - 4) / (t + 4))
    bias = (t - p) / (t + F.greatest(p, F.lit(1)))
    return out.withColumn("rl_status", F.when(t < F.floor(p / 2), "below_rl_threshold").when(bias > 0.2, "biased_rl").when(t.isNotNull(), "valid_rl"))


def percent_correct(trials: DataFrame) -> DataFrame:
    """Accuracy of valid choices by session and side, and of whole sessions (side null), from one grouping-sets pass."""
    rows = trials.where("valid").select("session", "state", "correct")
    return rows.groupingSets([["session", "state"], ["session"]], "session", "state").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))


def block_switches(trials: DataFrame) -> DataFrame:
    """Switches per block run; rows without a choice take the previous action, else the next one, of the block."""
    rows = with_runs(trials, "block", "block_run")
    w = ordered("session", "block_run")
    following = w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("filled", F.coalesce("action", F.last("action", True).over(before("session", "block_run")), F.first("action", True).over(following)))
    rows = rows.withColumn("moved", F.coalesce((F.col("filled") != F.lag("filled").over(w)).cast("int"), F.lit(0)))
    out = rows.groupBy("session", "block_run").agg(F.sum("moved").alias("switches"), F.count("*").alias("n"))
    return out.withColumn("switch_rate", F.try_divide(F.col("switches").cast("double"), F.col("n") - 1))


def zero_ttc(per_block: DataFrame) -> DataFrame:
    """Blocks after the first that are right at once, by session and side and overall (side null)."""
    rows = per_block.where(F.col("block_run") > 1).select("session", "state", (F.col("trials_to_correct") == 0).cast("int").alias("zero"))
    out = rows.groupingSets([["session", "state"], ["session"]], "session", "state").agg(F.count("zero").alias("n"), F.coalesce(F.sum("zero"), F.lit(0)).alias("n_zero"))
    return out.withColumn("fraction", F.try_divide(F.col("n_zero").cast("double"), F.col("n")))


def quartile_card(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """N, first quartile, median, third quartile of a metric by key, linearly interpolated; nulls don't count."""
    p = lambda q: F.percentile(metric, F.lit(q))
    return rows.groupBy(*keys).agg(F.count(metric).alias("n"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"))


def side_bias(trials: DataFrame) -> DataFrame:
    """Chosen and true sides of valid trials, their ratio and the signed bias."""
    rows = trials.where("valid")
    out = rows.groupBy("session").agg(F.count_if(F.col("action") == 1).alias("n_left"), F.count_if(F.col("action") == 0).alias("n_right"), F.count_if(F.col("state") == 1).alias("true_left"), F.count("*").alias("n"))
    out = out.withColumn("left_ratio", F.try_divide(F.col("n_left").cast("double"), F.col("true_left")))
    return out.withColumn("signed_bias", F.try_divide((F.col("n_left") - F.col("n_right")).cast("double"), F.col("n")))


def session_regression(per_block: DataFrame) -> DataFrame:
    """Slope, intercept and R2 of trials_to_correct on the preceding block's rewards, per session."""
    rows = per_block.where("trials_to_correct IS NOT NULL AND block_run > 1").select("session", F.col("trials_to_correct").cast("double").alias("y"), F.col("prev_n_rewarded").cast("double").alias("x"))
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def switch_persistence(trials: DataFrame) -> DataFrame:
    """After a side change, stay or switch by choice index, by direction and over both (direction null).

    A block is left out when it never switches, or has a row without a choice or a manual reward before its first row
    on the new side; only rows before that row (stay) and the row itself (switch) count.
    """
    rows = with_runs(trials, "block", "block_run")
    # the preceding block's side is that of the row just before this block: taken along in the same ordered pass
    rows = rows.withColumn("_state", F.lag("state").over(ordered()))
    w, whole = ordered("session", "block_run"), Window.partitionBy("session", "block_run")
    rows = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("side", F.first("state").over(w)).withColumn("was", F.first("_state").over(w))
    rows = rows.where("was IS NOT NULL AND was != side")
    rows = rows.withColumn("first", F.min(F.when(F.col("action") == F.col("side"), F.col("pos"))).over(whole))
    early = F.col("pos") <= F.col("first")
    rows = rows.withColumn("bad", F.max(F.when(early & ~F.col("valid"), 1).otherwise(0)).over(whole)).where("first IS NOT NULL AND bad = 0").where(early)
    rows = rows.select(F.when(F.col("side") == 1, "to_left").otherwise("to_right").alias("direction"), F.col("pos").alias("choice_index"), (F.col("pos") == F.col("first")).cast("int").alias("switched"))
    out = rows.groupingSets([["direction", "choice_index"], ["choice_index"]], "direction", "choice_index").agg(F.count("*").alias("n"), F.sum("switched").alias("n_switch"))
    return out.withColumn("p_switch", F.col("n_switch") / F.col("n"))


def post_first_correct(trials: DataFrame, most: int | None = None) -> DataFrame:
    """Accuracy by index after a block's first correct valid choice (index 0 is that choice), by side and over both.

    Every index of every block counts; with `most`, only the first so many indices.
    """
    rows = with_runs(trials, "block", "block_run").where("valid")
    rows = rows.withColumn("ix", F.sum("correct").over(upto("session", "block_run"))).where("ix >= 1")
    rows = rows.withColumn("ix", F.row_number().over(ordered("session", "block_run")) - 1)
    rows = rows if most is None else rows.where(F.col("ix") < most)
    return rows.groupingSets([["state", "ix"], ["ix"]], "state", "ix").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))


def choice_windows(values: DataFrame, size: int = 10) -> DataFrame:
    """Full windows of `size` valid choices that don't overlap: agreement of the column greedy, rewards, block changes."""
    rows = values.withColumn("win", F.floor((F.row_number().over(ordered()) - 1) / size)).withColumn("moved", F.coalesce((F.col("block") != F.lag("block").over(ordered())).cast("int"), F.lit(0)))
    out = rows.groupBy("session", "win").agg(F.count("*").alias("n"), F.avg((F.col("greedy") == F.col("action")).cast("double")).alias("agreement"), F.sum("reward").alias("rewards"), F.sum("moved").alias("transitions"))
    return out.where(F.col("n") == size).drop("n")


def cohort_means(sessions: DataFrame, groups: DataFrame, metric: str) -> DataFrame:
    """Mean over sessions of a session metric with every session counting the same, by group and region."""
    return sessions.join(groups, "session").groupBy("group", "region").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))


def learning_curve(trials: DataFrame) -> DataFrame:
    """Accuracy per block run in order, numbered from 1."""
    rows = with_runs(trials.where("valid"), "block", "number")
    return rows.groupBy("session", "number").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))


def sliding_regression(per_block: DataFrame, width: int = 5, step: int = 2) -> DataFrame:
    """Slope of trials_to_correct on the preceding rewards over every width blocks, each step; 0 when x is constant."""
    rows = per_block.where("trials_to_correct IS NOT NULL AND block_run > 1").withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("block_run")) - 1)
    w = Window.partitionBy("session").orderBy("block_run").rowsBetween(0, width - 1)
    x, y = F.col("prev_n_rewarded").cast("double"), F.col("trials_to_correct").cast("double")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("slope", F.coalesce(F.regr_slope(y, x).over(w), F.lit(0.0)))
    return rows.where((F.col("n") == width) & (F.col("pos") % step == 0)).select("session", "pos", "slope")


def centred_rewards(per_block: DataFrame) -> DataFrame:
    """The preceding rewards less their mean in the session, and the side as -1 or 1."""
    mean = F.avg("prev_n_rewarded").over(Window.partitionBy("session"))
    return per_block.select("session", "block_run", (F.col("prev_n_rewarded") - mean).alias("centred"), (2 * F.col("state") - 1).alias("side_code"))


def residual_spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median absolute deviation (plain and times 1.4826), interquartile range, root mean square and sample deviation.

    Keys may be few and their rows many: quantiles come from range-partitioned ranks. The keys' own figures are broadcast.
    """
    x = F.col(value).cast("double")
    middle = quantiles(rows, keys, value, (0.25, 0.5, 0.75))
    off = rows.join(F.broadcast(middle), keys).withColumn("_off", F.abs(x - F.col("q1")))
    spread = quantiles(off, keys, "_off", (0.5,)).withColumnRenamed("q0", "mad")
    sums = rows.groupBy(*keys).agg(F.sqrt(F.avg(x * x)).alias("rmse"), F.stddev_samp(x).alias("sd"))
    out = sums.join(middle, keys).join(spread, keys).withColumn("iqr", F.col("q2") - F.col("q0")).drop("q0", "q1", "q2")
    return out.withColumn("mad_scaled", F.col("mad") * 1.4826)


def switches_by_omissions(trials: DataFrame, most: int | None = None) -> DataFrame:
    """A29 and A16 over C01: chance to switch by the omissions in a row before a trial, per session and over all (null).

    Every count has its own row; with `most`, longer runs are pooled in the row of that count.
    """
    rows = reward_counters(trials).withColumn("switch", (F.col("action") != F.lag("action").over(ordered())).cast("int")).where("switch IS NOT NULL")
    count = F.col("consecutive_omissions") if most is None else F.least("consecutive_omissions", F.lit(most))
    rows = rows.select("session", count.alias("omissions"), "switch")
    return rows.groupingSets([["session", "omissions"], ["omissions"]], "session", "omissions").agg(F.count("*").alias("n"), F.sum("switch").alias("switches"), F.avg("switch").alias("p_switch"))
