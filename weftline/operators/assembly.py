"""Event logs to trials, and features of neighbouring trials and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.history import before, ordered, terminal_omission_streaks, upto, with_runs


def event_category(event: Column) -> Column:
    """The family of a log event, by its name; null for the rest."""
    return (
        F.when(event.rlike("^(correct|wrong)_choice_|^invalid_switch$"), "choice").when(event.rlike("^enter_"), "context")
        .when(event.rlike("^giving_reward_"), "reward").when(event.rlike("^LED_"), "stimulus").when(event.isin("trial_start", "trial_stop"), "trial")
    )


def assemble_trials(log: DataFrame) -> DataFrame:
    """A row for each trial of a log (session, t, seq, event, note): times, block, side, first outcome, its note.

    A trial lasts from its trial_start to the next; contexts entered before it number its block. The first terminal
    event sets the outcome, n_outcomes tells of more. A last trial without outcome is dropped, an earlier one is 'unknown'.
    """
    event = F.col("event")
    rows = log.withColumn("trial", F.sum((event == "trial_start").cast("int")).over(upto())).withColumn("_enter", event.rlike("^enter_(left|right)_patch$"))
    rows = rows.withColumn("block", F.sum(F.col("_enter").cast("int")).over(upto()))
    rows = rows.withColumn("side", F.last(F.when(F.col("_enter"), F.when(event == "enter_left_patch", 1).otherwise(0)), True).over(upto()))
    end, at = event_category(event) == "choice", F.struct("t", "seq")
    start = event == "trial_start"
    out = rows.where("trial > 0").groupBy("session", "trial").agg(
        F.min(F.when(start, F.col("t"))).alias("start"), F.min(F.when(start, F.col("block"))).alias("block"), F.min(F.when(start, F.col("side"))).alias("side"),
        F.count_if(end).alias("n_outcomes"), F.min_by("event", F.when(end, at)).alias("outcome"), F.min_by("note", F.when(end, at)).alias("note"), F.min(F.when(end, F.col("t"))).alias("choice_time"),
    )
    last = F.max("trial").over(Window.partitionBy("session"))
    out = out.withColumn("_last", last).where("n_outcomes > 0 OR trial < _last").drop("_last")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("unknown")))


def decode_outcomes(trials: DataFrame) -> DataFrame:
    """Action (1 left, 0 right, null none), correct and reward from outcome and note; a note that is neither fails the job."""
    name = F.col("outcome")
    action = F.when(name.rlike("_choice_left_"), 1).when(name.rlike("_choice_right_"), 0)
    paid = F.when(F.col("note") == "reward_True", 1).when(F.col("note") == "reward_False", 0).otherwise(F.raise_error(F.concat(F.lit("unknown note: "), F.coalesce("note", F.lit("null")))))
    return trials.withColumn("action", action).withColumn("correct", F.when(action.isNotNull(), name.startswith("correct_").cast("int"))).withColumn("reward", F.when(action.isNotNull(), paid))


def neighbour_targets(trials: DataFrame) -> DataFrame:
    """J18, J13 in part: of the rows just before and after: action, reward, switch; null with a reason where one is no valid choice."""
    w = ordered()
    rows = trials.withColumn("_pv", F.coalesce(F.lag("valid").over(w), F.lit(False))).withColumn("_nv", F.coalesce(F.lead("valid").over(w), F.lit(False)))
    was, then = F.col("valid") & F.col("_pv"), F.col("valid") & F.col("_nv")
    rows = rows.withColumn("_pa", F.lag("action").over(w)).withColumn("_na", F.lead("action").over(w)).withColumn("_pr", F.lag("reward").over(w))
    rows = rows.withColumn("prev_action", F.when(was, F.col("_pa"))).withColumn("prev_reward", F.when(was, F.col("_pr"))).withColumn("next_action", F.when(then, F.col("_na")))
    rows = rows.withColumn("switched", (F.col("action") != F.col("prev_action")).cast("int")).withColumn("will_switch", (F.col("action") != F.col("next_action")).cast("int"))
    reason = F.concat_ws(";", F.when(~F.col("valid"), "no_valid_choice"), F.when(~F.col("_pv"), "previous_not_valid"), F.when(~F.col("_nv"), "next_not_valid"))
    return rows.withColumn("reason", reason).drop("_pv", "_nv", "_pa", "_na", "_pr")


def augment(trials: DataFrame) -> DataFrame:
    """T08 in part: action and reward of the row before, whatever it is, and the place in the block run (from 0)."""
    rows = with_runs(trials, "block", "block_run").withColumn("prev_action", F.lag("action").over(ordered())).withColumn("prev_reward", F.lag("reward").over(ordered()))
    return rows.withColumn("trial_in_block", F.row_number().over(ordered("session", "block_run")) - 1)


def previous_block_omissions(trials: DataFrame) -> DataFrame:
    """Right but unrewarded choices of the preceding block run, all and those at its end; 0 for the first."""
    rows = with_runs(trials, "block", "block_run")
    missed = F.col("valid") & (F.col("correct") == 1) & (F.col("reward") == 0)
    own = rows.groupBy("session", "block_run").agg(F.count_if(missed).alias("_n")).join(terminal_omission_streaks(trials).select("session", "block_run", "terminal_streak"), ["session", "block_run"], "left")
    w = Window.partitionBy("session").orderBy("block_run")
    shift = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0)).cast("bigint")
    return own.select("session", "block_run", shift("_n").alias("prev_omissions"), shift("terminal_streak").alias("prev_streak"))


def relative_tts(per_block: DataFrame, lines: DataFrame) -> DataFrame:
    """What the session's line (A11) predicts, the residual, and its percentile rank in the session (average ranks; 0 alone)."""
    rows = per_block.where("trials_to_correct IS NOT NULL AND block_run > 1").join(lines.select("session", "slope", "intercept"), "session")
    rows = rows.withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("prev_n_rewarded")).withColumn("residual", F.col("trials_to_correct") - F.col("predicted"))
    rows = rows.where("residual IS NOT NULL AND NOT isnan(residual)").withColumn("_r", F.round("residual", 9))  # ties of values that differ in their last bits
    n = F.count("*").over(Window.partitionBy("session"))
    rank = F.rank().over(Window.partitionBy("session").orderBy("_r")) + (F.count("*").over(Window.partitionBy("session", "_r")) - 1) / 2
    return rows.withColumn("percentile", F.coalesce(F.try_divide(rank - 1, n - 1), F.lit(0.0))).drop("_r")


def welch(samples: DataFrame, rate: float, size: int) -> DataFrame:
    """One-sided power density of evenly sampled series (series, i, v), i from 0 without gaps.

    Periodic Hann, half overlapping segments of `size` (even) samples, each less its mean; a short series has no rows.
    Each sample meets its two segments and size / 2 + 1 frequencies; the sums combine before the shuffle.
    """
    half = size // 2
    rows = samples.join(F.broadcast(samples.groupBy("series").agg(F.max("i").alias("_last"))), "series")  # a row for each series
    s = F.floor(F.col("i") / half)
    rows = rows.withColumn("segment", F.explode(F.array(s, s - 1))).where(F.col("segment") >= 0).where(F.col("segment") * half + size - 1 <= F.col("_last"))
    rows = rows.withColumn("_k", F.col("i") - F.col("segment") * half).withColumn("_d", F.col("v") - F.avg("v").over(Window.partitionBy("series", "segment")))
    turn = 2 * F.lit(3.141592653589793) * F.col("_k") / size
    rows = rows.withColumn("_x", F.col("_d") * (0.5 - 0.5 * F.cos(turn))).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(half))))
    angle = turn * F.col("f")
    parts = rows.groupBy("series", "segment", "f").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), F.sum(F.col("_x") * F.sin(angle)).alias("im"))
    sides = F.when((F.col("f") == 0) | (F.col("f") == half), 1.0).otherwise(2.0)
    power = sides * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (rate * 0.375 * size)  # 0.375: mean square of the window
    out = parts.groupBy("series", "f").agg(F.avg(power).alias("density"), F.count("*").alias("segments"))
    return out.withColumn("frequency", F.col("f") * rate / size)


def band_power(spectrum: DataFrame, low: float, high: float) -> DataFrame:
    """G11 in part: mean density from low to high by trapezoids over the frequencies inside."""
    w = Window.partitionBy("series").orderBy("frequency")
    rows = spectrum.where(F.col("frequency").between(low, high)).withColumn("_f", F.lead("frequency").over(w)).withColumn("_d", F.lead("density").over(w))
    area = F.sum((F.col("density") + F.col("_d")) / 2 * (F.col("_f") - F.col("frequency")))
    return rows.groupBy("series").agg(F.try_divide(area, F.max("frequency") - F.min("frequency")).alias("power"))


def table_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """By key, rows and the sum of 60 bits of each row's SHA-256: equal for equal bags of rows in any order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))
