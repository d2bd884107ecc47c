"""Bins of variable length, lagged designs, folds, phases at events, exemplars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.align import interval_join


def variable_bins(windows: DataFrame, width: int) -> DataFrame:
    """Windows (session, ref, t0, stop) cut into bins of `width`: bin (from 0) and its left edge; the rest that fills no bin is left out."""
    n = F.floor((F.col("stop") - F.col("t0")) / width)
    rows = windows.withColumn("bin", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))))
    return rows.withColumn("edge", F.col("t0") + F.col("bin") * width)


def select_bins(bins: DataFrame, event: str, low: int, high: int) -> DataFrame:
    """The bins whose left edge is at event + low or later and before event + high."""
    return bins.where((F.col("edge") >= F.col(event) + low) & (F.col("edge") < F.col(event) + high))


def valid_bin_rates(points: DataFrame, centres: DataFrame, low: int, bins: int, width: int, unit: str = "unit") -> DataFrame:
    """Per unit and bin, the trials whose bin is valid (its centre is no later than t0 + end) and the mean count per trial.

    centres: (session, ref, t0, end). A trial without events counts as zero in its valid bins.
    """
    middle = low + (F.col("bin") + 0.5) * width
    ends = centres.select("session", "ref", "end")
    rel = interval_join(points, centres.select("session", "ref", "t0"), low, low + bins * width - 1).withColumn("bin", F.floor((F.col("rel") - low) / width))
    n = rel.join(ends, ["session", "ref"]).where(middle <= F.col("end")).groupBy(unit, "bin").agg(F.count("*").alias("n"))
    valid = ends.groupBy("end").agg(F.count("*").alias("k")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).where(middle <= F.col("end"))
    trials = valid.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.sum("k").alias("trials"))
    grid = points.select(unit).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    grid = grid.join(F.broadcast(trials), "bin")  # at most `bins` rows
    out = grid.join(n, [unit, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("mean_count", F.col("n") / F.col("trials"))


def scale_activity(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Z by the mean and population deviation of each key; null where the deviation is 0."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def complete_episodes(members: DataFrame, activity: DataFrame, keys: Sequence[str], episode: str) -> DataFrame:
    """Per episode, its rows and whether activity has a row for every one of them."""
    known = activity.select(*keys).distinct().withColumn("_has", F.lit(1))
    out = members.join(known, list(keys), "left").groupBy(episode).agg(F.count("*").alias("n_rows"), F.count("_has").alias("n_covered"))
    return out.withColumn("complete", F.col("n_rows") == F.col("n_covered"))


def lagged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Columns `<name>_lag<k>` within each key; rows whose largest lag is outside, or where a value is null or not finite, go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    made = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags}
    out = rows.withColumns(made)
    for name in (*columns, *made):
        value = F.col(name).cast("double")
        out = out.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return out


def page(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of `size` rows of each key, in order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_at", at).where((F.col("_at") >= number * size) & (F.col("_at") < (number + 1) * size)).drop("_at")


def grouped_folds(rows: DataFrame, session: str, group: str, folds: int = 5) -> DataFrame:
    """Session, group, n, fold: whole groups go, largest first (ties: smaller group), to the lightest fold (ties: first).

    Null groups have no row; sessions with fewer groups than folds have the fold null. One session's group sizes are one
    array; rows never are.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(session, group).agg(F.count("*").alias("n"))
    per = sizes.groupBy(session).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g")))).alias("gs"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), folds).alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(state, g):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda x, i: F.when(i == at, x - g["m"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(at)).alias("to"))

    done = per.withColumn("to", F.aggregate("gs", zero, put)["to"]).withColumn("few", F.size("gs") < folds)
    out = done.select(session, "few", F.explode(F.arrays_zip("gs", "to")).alias("z"))
    return out.select(session, F.col("z.gs.g").alias(group), (-F.col("z.gs.m")).alias("n"), F.when(~F.col("few"), F.col("z.to")).alias("fold"))


def phase_at_events(points: DataFrame, samples: DataFrame, key: str = "session") -> DataFrame:
    """Phase of evenly sampled unit vectors (key, i, re, im) at points (key, seq, x), x in samples: interpolated linearly
    between the two neighbours and normalised again. Points without both neighbours have the phase null."""
    at = points.withColumn("i", F.floor("x")).withColumn("_f", F.col("x") - F.floor("x"))
    near = samples.select(key, "i", F.col("re").alias("r0"), F.col("im").alias("i0"))
    far = samples.select(key, (F.col("i") - 1).alias("i"), F.col("re").alias("r1"), F.col("im").alias("i1"))
    both = at.join(near.join(far, [key, "i"]), [key, "i"], "left")
    mixed = lambda a, b: F.col(a) + F.col("_f") * (F.col(b) - F.col(a))
    return both.withColumn("phase", F.atan2(mixed("i0", "i1"), mixed("r0", "r1"))).drop("_f", "r0", "r1", "i0", "i1")


def exemplars(rows: DataFrame, keys: Sequence[str], value: str, tie: str, p: float) -> DataFrame:
    """Of each key the row nearest to its p-quantile (linear interpolation), the smallest `tie` where several are as near."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.lit(p)).alias("quantile"))
    best = F.min(F.struct(F.abs(F.col(value) - F.col("quantile")), F.col(tie), F.col(value)))
    out = rows.where(F.col(value).isNotNull()).join(q, list(keys)).groupBy(*keys).agg(best.alias("_b"), F.first("quantile").alias("quantile"))
    return out.select(*keys, "quantile", F.col(f"_b.{tie}").alias(tie), F.col(f"_b.{value}").alias(value))


def coefficient_summary(coefficients: DataFrame, unit: str, folds: int = 5, positive: int = 4) -> DataFrame:
    """Per unit over its folds' coefficients: mean, positive folds, mid-rank percentile of the mean, and whether it is a
    candidate (all folds there, mean over 0, at least `positive` positive folds). Ranks are taken over one row a unit."""
    per = coefficients.groupBy(unit).agg(F.count("coefficient").alias("n_folds"), F.avg("coefficient").alias("mean"), F.count_if(F.col("coefficient") > 0).alias("n_positive"))
    usable, w = F.col("mean").isNotNull(), Window.partitionBy(F.col("mean").isNotNull())
    rank = F.rank().over(w.orderBy("mean")) + (F.count("*").over(Window.partitionBy("mean")) - 1) / 2
    out = per.withColumn("percentile", F.when(usable, (rank - 0.5) / F.count("mean").over(w)))
    return out.withColumn("candidate", (F.col("n_folds") == folds) & (F.col("mean") > 0) & (F.col("n_positive") >= positive))
