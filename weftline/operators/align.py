"""Alignment of point events: bucketed interval joins, peri-event histograms, interval sets, phase statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def interval_join(points: DataFrame, centres: DataFrame, low: int, high: int, key: str = "session") -> DataFrame:
    """Points with low <= t - t0 <= high, for centres (key, ref, t0) and points (key, t, ...); times in whole micros.

    Each centre is repeated for the few time buckets its window touches, so that the join is an equi-join on
    (key, bucket) and no session is compared with itself row by row.
    """
    width = max(high - low, 1)
    near = centres.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("t0") + low) / width), F.floor((F.col("t0") + high) / width))))
    found = points.withColumn("bucket", F.floor(F.col("t") / width)).join(near, [key, "bucket"])
    return found.withColumn("rel", F.col("t") - F.col("t0")).where(F.col("rel").between(low, high)).drop("bucket")


def psth(points: DataFrame, centres: DataFrame, low: int, bins: int, width: int, unit: str = "unit") -> DataFrame:
    """Per unit and bin, the count and the rate in events per second per centre; empty bins are there, the last edge is closed."""
    high = low + bins * width
    rel = interval_join(points, centres, low, high)
    counts = rel.withColumn("bin", F.least(F.floor((F.col("rel") - low) / width), F.lit(bins - 1)).cast("int")).groupBy(unit, "bin").agg(F.count("*").alias("n"))
    total = centres.agg(F.count("*").alias("centres"))
    dense = points.select(unit).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = dense.join(counts, [unit, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(total))
    return out.withColumn("rate", F.col("n") / (F.col("centres") * (width / MICROS))).drop("centres")


def merge_windows(windows: DataFrame, key: str = "session") -> DataFrame:
    """The union of half-open windows (key, start, stop); windows that touch are merged."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = windows.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))


def context_intervals(events: DataFrame, key: str = "session") -> DataFrame:
    """From each context entry (key, t, context) to the next, the last one open (stop null)."""
    return events.withColumn("stop", F.lead("t").over(Window.partitionBy(key).orderBy("t", "seq"))).withColumnRenamed("t", "start")


def timebase_map(points: DataFrame, anchors: DataFrame, key: str = "session") -> DataFrame:
    """Maps t of points (key, seq, t) through anchors (key, x, y): linear between anchors, the first or last segment's
    slope outside, a constant where there is one anchor. Both sides meet in one ordered union; no row pair is formed."""
    w = Window.partitionBy(key).orderBy("x")
    a = anchors.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w))
    use = F.when(F.col("x2").isNotNull(), F.struct(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).when(F.col("x0").isNotNull(), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    use = F.coalesce(use, F.struct(F.col("x"), F.col("y"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    both = a.select(key, F.col("x").alias("t"), F.lit(None).cast("bigint").alias("seq"), use.alias("seg"), F.lit(0).alias("side"))
    both = both.unionByName(points.select(key, "t", "seq", F.lit(1).alias("side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("t", "side")
    past = F.last("seg", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("seg", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("s", F.coalesce(past, ahead)).where("side = 1")
    slope = F.coalesce(F.try_divide(F.col("s.y2") - F.col("s.y"), F.col("s.x2") - F.col("s.x")), F.lit(0.0))
    return rows.select(key, "seq", "t", (F.col("s.y") + (F.col("t") - F.col("s.x")) * slope).alias("mapped"))


def phase_locking(points: DataFrame, keys: list[str], phase: str, least: int = 2, reliable: int = 50) -> DataFrame:
    """N, resultant length, pairwise phase consistency and preferred phase; sums of cosines and sines merge map-side."""
    s = points.groupBy(*keys).agg(F.count(phase).alias("n"), F.sum(F.cos(phase)).alias("c"), F.sum(F.sin(phase)).alias("s"))
    power, n = F.col("c") * F.col("c") + F.col("s") * F.col("s"), F.col("n")
    ppc = F.when(n >= least, (power - n) / (n * (n - 1)))
    direction = F.when(F.sqrt(power) > 2.220446049250313e-16 * F.greatest(n, F.lit(1)), F.atan2("s", "c"))
    return s.select(*keys, "n", F.try_divide(F.sqrt(power), n).alias("resultant"), ppc.alias("ppc"), direction.alias("direction"), (n >= reliable).alias("reliable"))


def phase_histogram(points: DataFrame, unit: str, phase: str, bins: int = 12) -> DataFrame:
    """Counts per unit and phase bin over [0, 2 pi)."""
    at = F.least(F.floor(F.col(phase) / F.lit(6.283185307179586) * bins), F.lit(bins - 1)).cast("int")
    return points.groupBy(unit, at.alias("bin")).agg(F.count("*").alias("n"))


def adjust_bh(rows: DataFrame, family: str, p: str, tie: str) -> DataFrame:
    """Benjamini-Hochberg q of each row within its family."""
    up, down = Window.partitionBy(family).orderBy(p, tie), Window.partitionBy(family).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy(family)) / F.row_number().over(up))
    return rows.withColumn("q", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q")


def signal_edges(samples: DataFrame, threshold: float) -> DataFrame:
    """Rising edges of samples (series, i, v) with the next fall; a rise without a fall is dropped."""
    w = Window.partitionBy("series").orderBy("i")
    rows = samples.withColumn("on", (F.col("v") >= threshold).cast("int"))
    rows = rows.withColumn("was", F.lag("on", 1, 0).over(w))
    rows = rows.withColumn("fall", F.min(F.when((F.col("on") == 0) & (F.col("was") == 1), F.col("i"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return rows.where("on = 1 AND was = 0 AND fall IS NOT NULL").select("series", F.col("i").alias("rise"), "fall", (F.col("fall") - F.col("i")).alias("width"))


def running_stats(samples: DataFrame, half: int = 3) -> DataFrame:
    """Running mean and first difference over 2 * half + 1 samples; windows are cut at the ends."""
    w = Window.partitionBy("series").orderBy("i")
    return samples.withColumn("mean", F.avg("v").over(w.rowsBetween(-half, half))).withColumn("step", F.col("v") - F.lag("v").over(w))


def hysteresis(samples: DataFrame, low: float, high: float) -> DataFrame:
    """1 from a sample at or over high until one at or under low; 0 before the first decision."""
    mark = F.when(F.col("v") >= high, 1).when(F.col("v") <= low, 0)
    w = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("is_on", F.coalesce(F.last(mark, True).over(w), F.lit(0)))
