"""Runs, counters and history features of trial tables.

Trial tables have session, t, seq, action (1, 0 or null), reward, correct, state, block and valid; rows of a session are
ordered by (t, seq). Each function is one or two window passes over the session; rows of different sessions never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = ("t", "seq")


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("session",))).orderBy(*ORDER)


def before(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)


def upto(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def with_runs(rows: DataFrame, value: str, name: str = "run", *keys: str) -> DataFrame:
    """Numbers the maximal runs of equal values (nulls equal) of each key from 1."""
    starts = ~F.col(value).eqNullSafe(F.lag(value).over(ordered(*keys))) | (F.row_number().over(ordered(*keys)) == 1)
    return rows.withColumn("_new", starts.cast("int")).withColumn(name, F.sum("_new").over(upto(*keys))).drop("_new")


def contiguous_runs(rows: DataFrame, value: str) -> DataFrame:
    """Session, run, value, first and last position (from 0) and length of every maximal run."""
    at = rows.withColumn("pos", F.row_number().over(ordered()) - 1)
    return with_runs(at, value).groupBy("session", "run").agg(F.first(value).alias("value"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


def incorrect_runs(trials: DataFrame) -> DataFrame:
    """Runs of wrong-side choices inside one correct-side episode; returned: the next valid trial is right and in the episode."""
    rows = with_runs(trials.where("valid"), "state", "episode").withColumn("wrong", 1 - F.col("correct"))
    rows = with_runs(rows.withColumn("_key", F.struct("episode", "wrong")), "_key")
    nxt = ordered()
    rows = rows.withColumn("back", (F.lead("correct").over(nxt) == 1) & (F.lead("episode").over(nxt) == F.col("episode")))
    runs = rows.where("wrong = 1").groupBy("session", "run").agg(F.first("state").alias("state"), F.count("*").alias("n"), F.max_by("back", F.struct(*ORDER)).alias("back"))
    return runs.select("session", "run", "state", "n", F.coalesce("back", F.lit(False)).alias("returned"))


def recurrence_without_context_change(trials: DataFrame) -> DataFrame:
    """Per session, completed excursions with a later run on the same side (eligible), those that recur, and the fraction.

    The eligible are just those that recur, so the fraction is 1 or null; that is the rule as it stands.
    """
    runs = incorrect_runs(trials)
    later = F.max("run").over(Window.partitionBy("session", "state"))
    runs = runs.withColumn("eligible", F.col("returned") & (later > F.col("run")))
    n = F.sum(F.col("eligible").cast("int"))
    return runs.groupBy("session").agg(n.alias("eligible"), n.alias("recurred")).withColumn("fraction", F.try_divide(F.col("recurred").cast("double"), F.col("eligible")))


def post_reward_excursions(trials: DataFrame) -> DataFrame:
    """Per session, rewarded valid choices with a valid neighbour (opportunities) and those whose next action differs."""
    rows = trials.where("valid").withColumn("next_action", F.lead("action").over(ordered()))
    open_ = (F.col("reward") > 0) & F.col("next_action").isNotNull()
    out = rows.groupBy("session").agg(F.count_if(open_).alias("opportunities"), F.count_if(open_ & (F.col("next_action") != F.col("action"))).alias("excursions"))
    return out.withColumn("rate", F.try_divide(F.col("excursions").cast("double"), F.col("opportunities")))


def rewarded_choice_switching(trials: DataFrame) -> DataFrame:
    """As W04, but only rows next to each other in the table count, and both must be valid."""
    w = ordered()
    rows = trials.withColumn("next_action", F.when(F.lead("valid").over(w), F.lead("action").over(w)))
    open_ = F.col("valid") & (F.col("reward") > 0) & F.col("next_action").isNotNull()
    out = rows.groupBy("session").agg(F.count_if(open_).alias("n"), F.count_if(open_ & (F.col("next_action") != F.col("action"))).alias("switches"))
    return out.withColumn("probability", F.try_divide(F.col("switches").cast("double"), F.col("n")))


def rewards_in_block(trials: DataFrame) -> DataFrame:
    """Adds the number of rewarded valid choices before each trial in its contiguous block run."""
    paid = F.when(F.col("valid"), F.col("reward")).otherwise(0)
    rows = with_runs(trials, "block", "block_run")
    return rows.withColumn("rewards_in_block", F.coalesce(F.sum(paid).over(before("session", "block_run")), F.lit(0)))


def reward_counters(trials: DataFrame) -> DataFrame:
    """C01, C02, C03 over valid rows: counters before each trial.

    consecutive_*: length of the run of like outcomes that ends just before; renewal_*: the same, kept through the
    opposite outcome and begun anew by the next chain; negative_value: omissions less rewards, value its mirror.
    """
    paid, missed = F.coalesce(F.col("reward") == 1, F.lit(False)), F.coalesce(F.col("reward") == 0, F.lit(False))
    rows = trials.where("valid").withColumn("_n", F.row_number().over(ordered()))  # all windows below have this one's order: one sort
    for name, here in (("rewards", paid), ("omissions", missed)):
        rows = rows.withColumn("_run", F.col("_n") - F.coalesce(F.max(F.when(~here, F.col("_n"))).over(upto()), F.lit(0)))
        rows = rows.withColumn(f"consecutive_{name}", F.coalesce(F.lag("_run").over(ordered()), F.lit(0)))
        rows = rows.withColumn(f"renewal_{name}", F.coalesce(F.last(F.when(here, F.col("_run")), True).over(before()), F.lit(0)))
    rows = rows.withColumn("negative_value", F.coalesce(F.sum(1 - 2 * F.col("reward")).over(before()), F.lit(0)))
    return rows.withColumn("value", -F.col("negative_value")).drop("_n", "_run")


def sided_values(trials: DataFrame) -> DataFrame:
    """Per-side omissions before each valid trial: the chosen side counts omissions and falls to 0 on its reward."""
    rows = trials.where("valid")
    for name, side in (("left", 1), ("right", 0)):
        mine = F.col("action") == side
        miss = F.when(mine & (F.col("reward") == 0), 1).otherwise(0)
        rows = rows.withColumn("_all", F.sum(miss).over(upto()))
        # what has come together since the side's last reward: the running sum less the sum there; one sort for both sides
        rows = rows.withColumn("_after", F.col("_all") - F.coalesce(F.last(F.when(mine & (F.col("reward") == 1), F.col("_all")), True).over(upto()), F.lit(0)))
        rows = rows.withColumn(f"omissions_{name}", F.coalesce(F.lag("_after").over(ordered()), F.lit(0))).drop("_all", "_after")
    return rows


def saturation(n: Column, rate: float) -> Column:
    return 1 - F.exp(-rate * n)


def counterfactual_doubt(trials: DataFrame, rate: float = 0.5) -> DataFrame:
    """Omissions on either side since the last reward, and sat(left) - sat(right), before each valid trial."""
    rows = trials.where("valid")
    for name, side in (("left", 1), ("right", 0)):
        miss = F.when((F.col("action") == side) & (F.col("reward") == 0), 1).otherwise(0)
        rows = rows.withColumn("_all", F.sum(miss).over(upto()))
        rows = rows.withColumn("_after", F.col("_all") - F.coalesce(F.last(F.when(F.col("reward") > 0, F.col("_all")), True).over(upto()), F.lit(0)))
        rows = rows.withColumn(f"doubt_{name}", F.coalesce(F.lag("_after").over(ordered()), F.lit(0)))
    rows = rows.withColumn("doubt_value", saturation(F.col("doubt_left"), rate) - saturation(F.col("doubt_right"), rate))
    return rows.drop("_all", "_after")


def trial_type_flags(trials: DataFrame) -> DataFrame:
    """Switch, stay, prev_correct, block_entry, first_switch_in_block and explore of valid rows."""
    w = ordered()
    rows = with_runs(trials.where("valid"), "block", "block_run").withColumn("prev_action", F.lag("action").over(w))
    rows = rows.withColumn("prev_correct", F.lag("correct").over(w)).withColumn("prev_reward", F.lag("reward").over(w))
    rows = rows.withColumn("is_switch", F.coalesce(F.col("action") != F.col("prev_action"), F.lit(False))).withColumn("is_stay", F.coalesce(F.col("action") == F.col("prev_action"), F.lit(False)))
    rows = rows.withColumn("block_entry", F.row_number().over(ordered("session", "block_run")) == 1)
    first = F.col("is_switch") & (F.sum(F.col("is_switch").cast("int")).over(upto("session", "block_run")) == 1)
    return rows.withColumn("first_switch_in_block", first).withColumn("explore", F.coalesce(F.col("is_switch") & (F.col("prev_correct") == 1) & (F.col("prev_reward") == 1), F.lit(False)))


def regressors(trials: DataFrame, epsilon: float = 1e-9, decay: float = 0.2) -> DataFrame:
    """relative_omissions, wsls, immediate persistence and hazard of valid rows, from the state before each."""
    w = ordered()
    rows = sided_values(trials).withColumn("prev_action", F.lag("action").over(w)).withColumn("prev_reward", F.lag("reward").over(w))
    signed = 2 * F.col("prev_action") - 1
    rows = rows.withColumn("relative_omissions", (F.col("omissions_left") - F.col("omissions_right")) / (F.col("omissions_left") + F.col("omissions_right") + epsilon))
    rows = rows.withColumn("persistence", F.coalesce(signed, F.lit(0))).withColumn("wsls", F.coalesce(F.when(F.col("prev_reward") == 1, signed).otherwise(-signed), F.lit(0)))
    return rows.withColumn("hazard", F.tanh(decay * (F.col("omissions_right") - F.col("omissions_left"))))


def terminal_omission_streaks(trials: DataFrame) -> DataFrame:
    """Per block run, the unrewarded correct valid choices that end it."""
    rows = with_runs(trials, "block", "block_run").where(F.col("valid") & (F.col("correct") == 1))
    back = Window.partitionBy("session", "block_run").orderBy(F.desc("t"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_paid", F.max("reward").over(back))
    return rows.groupBy("session", "block_run").agg(F.count("*").alias("n_correct"), F.count_if(F.col("_paid") == 0).alias("terminal_streak"))


def greedy_choices(values: DataFrame, value: str, start: int = 1) -> DataFrame:
    """adds greedy: the sign of the value, ties repeating the last decided choice, first ties the start side."""
    decided = F.when(F.col(value) > 0, 1).when(F.col(value) < 0, 0)
    return values.withColumn("greedy", F.coalesce(F.last(decided, True).over(upto()), F.lit(start)))


def agreement(values: DataFrame, value: str) -> DataFrame:
    """per session, the share of valid trials whose action is the greedy one."""
    rows = greedy_choices(values, value)
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.avg((F.col("greedy") == F.col("action")).cast("double")).alias("agreement"))


def switch_events(trials: DataFrame) -> DataFrame:
    """Neighbouring valid trials whose actions differ, with direction and the change of correctness."""
    w = ordered()
    rows = trials.withColumn("next_action", F.lead("action").over(w)).withColumn("next_correct", F.lead("correct").over(w)).withColumn("next_seq", F.lead("seq").over(w)).withColumn("next_valid", F.lead("valid").over(w))
    rows = rows.where(F.col("valid") & F.col("next_valid") & (F.col("action") != F.col("next_action")))
    name = lambda c: F.when(F.col(c) == 1, "correct").otherwise("wrong")
    return rows.select("session", "seq", "next_seq", F.when(F.col("next_action") == 1, "to_left").otherwise("to_right").alias("direction"), F.concat_ws("_to_", name("correct"), name("next_correct")).alias("transition"))


def central_motifs(trials: DataFrame) -> DataFrame:
    """Counts of (previous, current, next) outcome triples of three neighbouring valid trials by switch and stay keys."""
    w = ordered()
    rows = trials.withColumn("outcome", F.when(F.col("reward") == 1, "R").when(F.col("correct") == 1, "O").otherwise("X"))
    for k, f in (("p", F.lag), ("n", F.lead)):
        rows = rows.withColumn(f"_o{k}", f("outcome").over(w)).withColumn(f"_a{k}", f("action").over(w)).withColumn(f"_v{k}", f("valid").over(w))
    rows = rows.where("valid AND _vp AND _vn")
    key = F.concat("_op", "outcome", "_on").alias("outcomes")
    moves = F.concat(F.when(F.col("_ap") == F.col("action"), "r").otherwise("s"), F.when(F.col("_an") == F.col("action"), "r").otherwise("s")).alias("moves")
    return rows.groupBy(key, moves).agg(F.count("*").alias("n"))
