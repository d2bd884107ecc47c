"""States before every trial, explore runs, splits whose rows do not overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.history import ordered, reward_counters, upto, with_runs

COUNTERS = ["consecutive_rewards", "consecutive_omissions", "renewal_rewards", "renewal_omissions", "negative_value"]


def decision_table(trials: DataFrame) -> DataFrame:
    """The counters of C01 to C03 before every trial; a trial that is not valid has the state that then stands and leaves it as it is.

    A row after each session's last trial gives the state at its end.
    """
    rows = trials.select("session", "t", "seq", "reward", "valid")
    end = rows.groupBy("session").agg(F.max("t").alias("t")).select("session", "t", F.lit((1 << 63) - 1).alias("seq"), F.lit(0).alias("reward"), F.lit(True).alias("valid"))
    states = reward_counters(rows.unionByName(end)).select("session", "t", "seq", *COUNTERS)
    skipped = rows.where("NOT coalesce(valid, false)").select("session", "t", "seq", *[F.lit(None).cast("bigint").alias(c) for c in COUNTERS])
    both, w = states.unionByName(skipped), ordered().rowsBetween(0, Window.unboundedFollowing)
    return both.withColumns({c: F.first(c, True).over(w) for c in COUNTERS}).where(F.col("seq") < (1 << 63) - 1)


def explore_runs(trials: DataFrame, most: int = 5) -> DataFrame:
    """Runs of valid choices of one side in a block run: session, block_run, run, n, explore. A run explores when the
    choice before it in the block run was right and rewarded, it has at most `most` choices and the next one is right."""
    rows = with_runs(trials, "block", "block_run").where("valid")
    starts = ~F.col("action").eqNullSafe(F.lag("action").over(ordered("session", "block_run")))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(upto("session", "block_run")))
    at = F.struct("t", "seq")
    runs = rows.groupBy("session", "block_run", "run").agg(
        F.count("*").alias("n"), F.min_by("correct", at).alias("_first"), F.max_by(((F.col("correct") == 1) & (F.col("reward") == 1)).cast("int"), at).alias("_paid")
    )
    w = Window.partitionBy("session", "block_run").orderBy("run")
    explore = (F.lag("_paid", 1, 0).over(w) == 1) & (F.col("n") <= most) & (F.lead("_first", 1, 0).over(w) == 1)
    return runs.withColumn("explore", explore).drop("_first", "_paid")


def explore_counts(runs: DataFrame, least: int = 1) -> DataFrame:
    """Per block run, explore runs of at least `least` choices and their choices; 0 where there are none."""
    good = F.col("explore") & (F.col("n") >= least)
    return runs.groupBy("session", "block_run").agg(F.count_if(good).alias("n_runs"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("n_trials"))


def purged_splits(rows: DataFrame, session: str, order: list[str], start: str, stop: str, folds: int = 5) -> DataFrame:
    """Each row (windows [start, stop), in the order of their start) once a fold, with its role: test in its own
    contiguous fold, purged where its window overlaps that fold's, otherwise train, of which the last fifth (rounded up) is validation."""
    w = Window.partitionBy(session).orderBy(*order)
    own = rows.withColumn("_own", F.ntile(folds).over(w) - 1).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    each, test = Window.partitionBy(session, "fold"), F.col("_own") == F.col("fold")
    own = own.withColumn("_lo", F.min(F.when(test, F.col(start))).over(each)).withColumn("_hi", F.max(F.when(test, F.col(stop))).over(each))
    role = F.when(test, "test").when((F.col(start) < F.col("_hi")) & (F.col(stop) > F.col("_lo")), "purged").otherwise("train")
    own = own.withColumn("role", role)
    back = F.row_number().over(Window.partitionBy(session, "fold", "role").orderBy(*[F.desc(o) for o in order]))
    n = F.count("*").over(Window.partitionBy(session, "fold", "role"))
    own = own.withColumn("_back", back).withColumn("_n", n)
    return own.withColumn("role", F.when((F.col("role") == "train") & (F.col("_back") <= F.ceil(F.col("_n") / 5)), "validation").otherwise(F.col("role"))).drop("_own", "_lo", "_hi", "_back", "_n")
