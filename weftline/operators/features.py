"""Trial and block features: labels, recoding, clocks, block transitions, summaries of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.history import ordered, upto, with_runs


def finish_trials(trials: DataFrame, start: str, low: float | None = None, high: float | None = None, **constants: float) -> DataFrame:
    """Seconds since the session's first trial, constant columns, and only trials with low <= seconds <= high. Ties in time keep the order of seq."""
    seconds = F.col(start).cast("double") - F.min(F.col(start).cast("double")).over(Window.partitionBy("session"))
    rows = trials.withColumn("session_time", seconds).withColumns({k: F.lit(v) for k, v in constants.items()})
    keep = F.lit(True) if low is None else F.col("session_time") >= low
    return rows.where(keep if high is None else keep & (F.col("session_time") <= high))


def numeric_label(label: str, needed: Column) -> Column:
    """True, false, 0 and 1 in any case as 1 and 0; null where there is none, which fails the job where `needed` holds."""
    text = F.lower(F.trim(F.col(label).cast("string")))
    value = F.when(text.isin("true", "1", "1.0"), 1).when(text.isin("false", "0", "0.0"), 0)
    return F.when(value.isNull() & needed, F.raise_error(F.lit(f"a valid choice without {label}")).cast("int")).otherwise(value)


def block_type(state: str, cue: str) -> Column:
    """Left or right by state (1, 0), cued where the cue is not null."""
    return F.concat(F.when(F.col(state) == 1, "left").when(F.col(state) == 0, "right"), F.when(F.col(cue).isNull(), "_uncued").otherwise("_cued"))


def sync_clock(messages: DataFrame) -> DataFrame:
    """Messages (session, t, seq, label, interval in us) with `clock` in seconds: the sum of the sync intervals before a
    message plus its own interval; before the first sync just its own."""
    sync = F.when(F.col("label") == "syncPinState", F.col("interval")).otherwise(0)
    before = F.sum(sync).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("clock", (F.coalesce(before, F.lit(0)) + F.col("interval")) / 1e6)


def zero_hold(speeds: DataFrame, gap: float = 0.002, lead: float = 0.001) -> DataFrame:
    """(session, t, v) with, after a zero that is followed by over `gap` seconds of silence, one more zero `lead` seconds before the next reading."""
    rows = speeds.select("session", "t", "v", F.lit(False).alias("added"))
    after = rows.withColumn("_next", F.lead("t").over(Window.partitionBy("session").orderBy("t")))
    more = after.where((F.col("v") == 0) & (F.col("_next") - F.col("t") > gap)).select("session", (F.col("_next") - lead).alias("t"), "v", F.lit(True).alias("added"))
    return rows.unionByName(more)


def leave_stay(trials: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """Stay (1 as the row before, 0 otherwise, null where a side is missing); left-positive values, as `<name>_prev`, made positive for the side of the row before."""
    prev = F.lag("action").over(ordered())
    rows = trials.withColumn("prev_action", prev).withColumn("stay", (F.col("action") == F.col("prev_action")).cast("int"))
    return rows.withColumns({f"{v}_prev": F.col(v) * (2 * F.col("prev_action") - 1) for v in values})


def observer_value(belief: str, doubt: str) -> Column:
    """C11: belief less relative doubt, both left-positive; null if either is."""
    return F.col(belief) - F.col(doubt)


def residualize(rows: DataFrame, target: str, control: str, *keys: str) -> DataFrame:
    """C12 with one control: what the least-squares line of each key leaves of the target; a constant control leaves the deviation from the mean."""
    both = F.col(target).isNotNull() & F.col(control).isNotNull()
    y, x = F.when(both, F.col(target)), F.when(both, F.col(control))
    line = rows.groupBy(*keys).agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"), F.coalesce(F.try_divide(F.covar_pop(y, x), F.var_pop(x)), F.lit(0.0)).alias("_b"))
    out = rows.join(line, list(keys)).withColumn("residual", F.col(target) - F.col("_my") - F.col("_b") * (F.col(control) - F.col("_mx")))
    return out.drop("_my", "_mx", "_b")


def unique_maximum(rows: DataFrame, columns: Sequence[str], atol: float = 1e-12) -> DataFrame:
    """winner (0-based place of the sole largest column, -1 on ties and invalid rows) and tie (1, 0, -1 where a value is null)."""
    values = F.array(*columns)
    usable = ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
    rows = rows.withColumn("_best", F.filter(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.array_max(values) - F.get(values, i) <= atol))
    sole = F.size("_best") == 1
    rows = rows.withColumn("winner", F.when(usable & sole, F.col("_best")[0]).otherwise(-1)).withColumn("tie", F.when(~usable, -1).when(sole, 0).otherwise(1))
    return rows.drop("_best")


def exclusion_reasons(trials: DataFrame) -> DataFrame:
    """`reason`, the causes for which a trial takes no part in a history, joined by ';' ('' where it does)."""
    return trials.withColumn("reason", F.concat_ws(";", F.when(F.col("action").isNull(), "no_choice"), F.when(F.col("manual") == 1, "manual_reward"), F.when(F.col("reward").isNull(), "no_reward_value")))


def block_transitions(trials: DataFrame) -> DataFrame:
    """Per block run, over its valid choices from the first right one on: width (1 + offset of the last wrong one, 0 if
    none), wrong choices, falls from right to wrong, short (two rows or fewer). Without a right one figures are null and short holds."""
    w = ordered("session", "block_run")
    rows = with_runs(trials, "block", "block_run").where("valid").withColumn("_seen", F.max("correct").over(upto("session", "block_run")))
    rows = rows.withColumn("_after", F.col("_seen") == 1).withColumn("_i", F.row_number().over(w)).withColumn("_was", F.lag("correct").over(w))
    after, wrong = F.col("_after"), F.col("_after") & (F.col("correct") == 0)
    out = rows.groupBy("session", "block_run").agg(
        F.count_if(after).alias("_n"), F.min(F.when(after, F.col("_i"))).alias("_first"), F.max(F.when(wrong, F.col("_i"))).alias("_last"),
        F.count_if(wrong).alias("_wrong"), F.count_if(wrong & (F.col("_was") == 1)).alias("_falls"),
    )
    found = F.col("_n") > 0
    return out.select(
        "session", "block_run", (~found).alias("no_switch"), F.when(found, F.coalesce(F.col("_last") - F.col("_first") + 1, F.lit(0))).alias("width"),
        F.when(found, F.col("_wrong")).alias("reversion_choices"), F.when(found, F.col("_falls")).alias("reversion_events"), (F.col("_n") <= 2).alias("short"),
    )


def ttc_summary(per_block: DataFrame) -> DataFrame:
    """Per session the mean of trials_to_correct by state and overall, and how many blocks but the last have none."""
    last = F.max("block_run").over(Window.partitionBy("session")) == F.col("block_run")
    missing = F.col("trials_to_correct").isNull() & ~F.col("_last")
    side = lambda s: F.avg(F.when(F.col("state") == s, F.col("trials_to_correct")))
    return per_block.withColumn("_last", last).groupBy("session").agg(side(1).alias("left_ttc"), side(0).alias("right_ttc"), F.avg("trials_to_correct").alias("overall_ttc"), F.count_if(missing).alias("n_missing"))


def oracle_summary(trials: DataFrame, p_active: str) -> DataFrame:
    """A10: per session, over valid choices: accuracy, reward collected, reward the better side would be expected to give, their ratio and difference."""
    per = trials.where("valid").groupBy("session").agg(F.avg("correct").alias("accuracy"), F.sum("reward").alias("collected"), F.sum(p_active).alias("expected"))
    return per.withColumn("fraction", F.when(F.col("expected") > 0, F.col("collected") / F.col("expected"))).withColumn("difference", F.col("collected") - F.col("expected"))


def agreement_delta(trials: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """By key, agreement of two models' 0/1 choices with the actions, their difference, and the counts of the four joint cases."""
    rows = trials.where("valid").withColumn("_a", (F.col(a) == F.col("action")).cast("int")).withColumn("_b", (F.col(b) == F.col("action")).cast("int"))
    case = lambda x, y: F.count_if((F.col("_a") == x) & (F.col("_b") == y))
    out = rows.groupBy(*keys).agg(F.avg("_a").alias("agree_a"), F.avg("_b").alias("agree_b"), case(1, 1).alias("n_both"), case(1, 0).alias("only_a"), case(0, 1).alias("only_b"), case(0, 0).alias("neither"))
    return out.withColumn("delta", F.col("agree_a") - F.col("agree_b"))


def exemplar_residuals(rows: DataFrame, x: str, y: str, lines: dict[str, tuple[float, float, float]]) -> DataFrame:
    """A row for each named line (intercept, slope, sd; few): residual y - (a + b x) and z = residual / sd."""
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(s)).alias("sd")) for n, (a, b, s) in lines.items()]))
    out = rows.withColumn("_l", spec).withColumn("line", F.col("_l.line")).withColumn("residual", F.col(y) - (F.col("_l.a") + F.col("_l.b") * F.col(x)))
    return out.withColumn("z", F.try_divide("residual", "_l.sd")).drop("_l")


def inherit_state(trials: DataFrame, states: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The state of each trial's block; null where the block has none or the trial is not valid. Keys repeat in no row of states."""
    return trials.join(states.select(*keys, F.col(name).alias("_s")), list(keys), "left").withColumn(name, F.when(F.col("valid"), F.col("_s"))).drop("_s")


def block_spans(trials: DataFrame, agree: Column) -> DataFrame:
    """First and last place (from 0) of each block run in its session, and the share of valid rows where `agree` (0/1) holds."""
    rows = with_runs(trials, "block", "block_run").withColumn("_pos", F.row_number().over(ordered()) - 1)
    return rows.groupBy("session", "block_run").agg(F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"), F.avg(F.when(F.col("valid"), agree)).alias("agreement"))


def clean_rows(rows: DataFrame, columns: dict[str, str], how: str = "any", missing: str = "None") -> DataFrame:
    """Casts the columns (name to type; texts that do not fit, and `missing`, become null) and drops rows where any, or all, are null."""
    out = rows.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit(missing)).try_cast(t) for c, t in columns.items()})
    return out.na.drop(how=how, subset=list(columns))


def trial_masks(trials: DataFrame) -> DataFrame:
    """A row per trial and mask that holds: valid, correct_rewarded, omission, incorrect, and switch or stay, by the next row where both are valid."""
    w = ordered()
    both = F.col("valid") & F.coalesce(F.lead("valid").over(w), F.lit(False))
    rows = trials.withColumn("_both", both).withColumn("_next", F.lead("action").over(w))
    ok, right, paid = F.col("valid"), F.col("correct") == 1, F.col("reward") == 1
    masks = {"valid": ok, "correct_rewarded": ok & right & paid, "omission": ok & right & ~paid, "incorrect": ok & ~right, "switch": F.col("_both") & (F.col("_next") != F.col("action")), "stay": F.col("_both") & (F.col("_next") == F.col("action"))}
    return rows.select("session", "seq", F.explode(F.array_compact(F.array(*[F.when(m, k) for k, m in masks.items()]))).alias("mask"))
