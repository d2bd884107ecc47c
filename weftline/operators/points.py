"""Interval sets, pairs of events, spikes by phase, and permutation nulls of phase consistency."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import align as al

TAU = 6.283185307179586


def subtract_windows(windows: DataFrame, holes: DataFrame, key: str = "session") -> DataFrame:
    """What is left of half-open windows (key, start, stop) without the holes: pieces (key, start, stop) of positive length.

    Both sides become +1 and -1 steps at their ends; one ordered running sum of each says where a window is open and no
    hole is, so that no window is compared with every hole.
    """
    steps = lambda df, c, n: df.where("stop > start").select(key, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(n).alias(c)), F.struct(F.col("stop").alias("t"), F.lit(-n).alias(c)))).alias("e")).select(key, "e.*")
    both = steps(windows, "win", 1).unionByName(steps(holes, "hole", 1), allowMissingColumns=True).groupBy(key, "t").agg(F.sum(F.coalesce("win", F.lit(0))).alias("win"), F.sum(F.coalesce("hole", F.lit(0))).alias("hole"))
    w = Window.partitionBy(key).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = (F.sum("win").over(upto) > 0) & (F.sum("hole").over(upto) == 0)
    pieces = both.withColumn("_open", open_).select(key, F.col("t").alias("start"), F.lead("t").over(w).alias("stop"), "_open").where("_open AND stop IS NOT NULL")
    return al.merge_windows(pieces.select(key, "start", "stop"), key).select(key, "start", "stop")


def clip_windows(windows: DataFrame, bounds: DataFrame, key: str = "session") -> DataFrame:
    """Windows cut to the key's bounds (key, low, high); an open stop becomes the bound; empty ones go."""
    cut = windows.join(bounds, key).withColumn("start", F.greatest("start", "low")).withColumn("stop", F.least(F.coalesce("stop", "high"), F.col("high")))
    return cut.where("stop > start").drop("low", "high")


def points_inside(points: DataFrame, windows: DataFrame, width: int, key: str = "session") -> DataFrame:
    """Points (key, t, ...) that lie in some half-open window, each once; windows meet them by time buckets of `width`."""
    near = windows.where("stop > start").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width)))).select(F.col(key).alias("_key"), "_b", "start", "stop")
    return points.join(near, (F.col(key) == F.col("_key")) & (F.floor(F.col("t") / width) == F.col("_b")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")), "left_semi")


def on_off_pairs(events: DataFrame, on: str, off: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Intervals (keys, start, stop) from an `on` event to the next event of its identity, where that is an `off`; others have no interval."""
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    rows = events.where(F.col("event").isin(on, off)).withColumn("stop", F.lead("t").over(w)).withColumn("_next", F.lead("event").over(w))
    return rows.where((F.col("event") == on) & (F.col("_next") == off)).select(*keys, F.col("t").alias("start"), "stop")


def bounded_map(points: DataFrame, anchors: DataFrame, policy: str = "extend", key: str = "session") -> DataFrame:
    """J04 with a policy for points outside the anchors: extend (the end segments' slope), null, drop, or error."""
    if policy not in ("extend", "null", "drop", "error"):
        raise ValueError(f"unknown policy: {policy}")
    rows = al.timebase_map(points, anchors, key)
    if policy == "extend":
        return rows
    ends = anchors.groupBy(key).agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    rows = rows.join(ends, key)
    out = (F.col("t") < F.col("_low")) | (F.col("t") > F.col("_high"))
    if policy == "drop":
        return rows.where(~out).drop("_low", "_high")
    other = F.lit(None) if policy == "null" else F.raise_error(F.lit("a point lies outside the anchors"))
    return rows.withColumn("mapped", F.when(out, other.cast("double")).otherwise(F.col("mapped"))).drop("_low", "_high")


def sampled_phase(points: DataFrame, phases: DataFrame, rate: float, least_amplitude: float = 0.0) -> DataFrame:
    """Phase and amplitude of points (series, seq, t in seconds) from samples (series, i, cr, ci, amplitude): unit
    vectors on the line between both neighbours, amplitudes on their own line; null where a neighbour is not valid, the
    vectors cancel, or the amplitude is under the least."""
    x = points.withColumn("_x", F.col("t") * rate).withColumn("_i", F.floor("_x")).withColumn("_w", F.col("_x") - F.col("_i"))
    both = x.withColumn("_p", F.explode(F.array(F.struct(F.col("_i").alias("i"), (1 - F.col("_w")).alias("w")), F.struct((F.col("_i") + 1).alias("i"), F.col("_w").alias("w"))))).select("series", "seq", "t", "_p.i", "_p.w").where("w > 0")
    got = both.join(phases.select("series", "i", "cr", "ci", "amplitude"), ["series", "i"], "left")
    line = lambda c: F.sum(F.col(c) * F.col("w"))
    out = got.groupBy("series", "seq", "t").agg(line("cr").alias("c"), line("ci").alias("s"), line("amplitude").alias("amplitude"), F.every(F.col("cr").isNotNull() & F.col("ci").isNotNull()).alias("ok"))
    ok = F.col("ok") & ((F.abs("c") > 1e-12) | (F.abs("s") > 1e-12)) & F.coalesce(F.col("amplitude") >= least_amplitude, F.lit(least_amplitude <= 0))
    return out.select("series", "seq", "t", F.when(ok, F.atan2("s", "c")).alias("phase"), "amplitude")


def phase_rates(points: DataFrame, occupancy: DataFrame, unit: str, phase: str, seconds: float, bins: int = 12, least: int = 50) -> DataFrame:
    """By unit and phase bin over [0, 2 pi): count, seconds that the signal's samples (phase, `seconds` each) spent
    there, the rate, the rate over the unit's mean, and whether the unit has points enough to be judged."""
    at = lambda c: F.least(F.floor(F.col(c) / F.lit(TAU) * bins), F.lit(bins - 1)).cast("int")
    time = occupancy.where(F.col(phase).isNotNull()).groupBy(at(phase).alias("bin")).agg((F.count("*") * seconds).alias("occupancy"))
    n = points.where(F.col(phase).isNotNull()).groupBy(unit, at(phase).alias("bin")).agg(F.count("*").alias("n"))
    dense = points.select(unit).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = dense.join(n, [unit, "bin"], "left").join(time, "bin", "left").select(unit, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("occupancy", F.lit(0.0)).alias("occupancy"))
    whole = Window.partitionBy(unit)
    mean = F.try_divide(F.sum("n").over(whole).cast("double"), F.sum("occupancy").over(whole))
    rows = rows.withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col("occupancy"))).withColumn("_mean", mean)
    return rows.withColumn("relative", F.try_divide("rate", "_mean")).withColumn("enough", F.sum("n").over(whole) >= least).drop("_mean")


def derangements(trials: DataFrame, shuffles: int, group: str = "session", seed: int = 17) -> DataFrame:
    """(group, shuffle, target, source): in each shuffle the trials of a group in an order by a hash, each taking the
    next one's place, the last the first's: no trial maps to itself. Groups of one trial have none."""
    rows = trials.select(group, "trial").distinct().withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    order = Window.partitionBy(group, "shuffle").orderBy(F.xxhash64("trial", "shuffle", F.lit(seed)), "trial")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(group, "shuffle"))).withColumn("_first", F.first("trial").over(order))
    return rows.select(group, "shuffle", F.col("trial").alias("target"), F.coalesce(F.lead("trial").over(order), F.col("_first")).alias("source"), "_n").where("_n > 1").drop("_n")


def _met(spikes: DataFrame, phases: DataFrame, group: str, width: int) -> DataFrame:
    """By group and stretch of `width` places i: arrays of its spikes and of the phases there, the group's trials, and
    whether the group has other stretches. Every spike and phase travels once, whatever the number of shuffles."""
    for c in ("trial", "i"):
        if dict(spikes.dtypes)[c] != dict(phases.dtypes)[c]:
            spikes, phases = (df.withColumn(c, F.col(c).cast("double")) for df in (spikes, phases))
    block = F.floor(F.col("i") / width)
    # a phase that is missing meets no spike, but its trial is one of the group's
    at = lambda df, *c: df.select(group, "trial", "i", *c).withColumn("_b", block).groupBy(group, "_b").agg(F.collect_list(F.struct("trial", "i", *c)).alias("_r"))
    points = at(spikes.where("trial IS NOT NULL AND i IS NOT NULL").select(group, "trial", "i", F.struct("unit").alias("unit")), "unit")
    waves = at(phases.where("trial IS NOT NULL AND phase IS NOT NULL").select(group, "trial", "i", "phase"), "phase")
    names = phases.select(group, "trial").distinct().groupBy(group).agg(F.sort_array(F.collect_list("trial")).alias("trials"))
    held = points.select(group, F.col("_b"), F.col("_r.trial").alias("trial"), F.col("_r.i").alias("i"), F.transform("_r", lambda v: v["unit"]["unit"]).alias("unit"))
    blocks = spikes.where("i IS NOT NULL").groupBy(group).agg((F.min(block) < F.max(block)).alias("more"))
    held = held.join(waves.select(group, "_b", F.col("_r.trial").alias("at"), F.col("_r.i").alias("of"), F.col("_r.phase").alias("phase")), [group, "_b"])
    return held.join(names.join(blocks, group), group).drop("_b")


def _edge_sums(met: DataFrame, orders: Column, turn: int, group: str, unit: str) -> DataFrame:
    """(group, unit, shuffle, n, c, s, trials) of _met by the orders of its trials, one array for each shuffle, in which a
    trial's spikes take the phases of the one `turn` before it, the first's those of the last; with a turn groups of one trial have none."""
    kind = dict(met.dtypes)[group]

    def number(*columns: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
        coded = pa.concat_arrays(columns).dictionary_encode(null_encoding="encode")
        return np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = lambda c: np.repeat(np.arange(b.num_rows), pc.list_value_length(b[c]).to_numpy(zero_copy_only=False))
            (trial, at, order), names = number(b["trial"].flatten(), b["at"].flatten(), b["orders"].flatten())
            (i, of), places = number(b["i"].flatten(), b["of"].flatten())
            (unit_of,), units = number(b["unit"].flatten())
            if not len(order):
                continue
            owner, t, p = row("orders"), max(len(names), 1), max(len(places), 1)
            draws = b["shuffles"].to_numpy()[0]
            slots = np.unique(owner * t + order)  # a slot for each trial of each group
            home = row("trial") * t + trial
            slot = np.minimum(np.searchsorted(slots, home), len(slots) - 1)
            mine = slots[slot] == home
            slot, i, g = slot[mine], i[mine], (row("unit") * len(units) + unit_of)[mine]
            keys, inverse = np.unique(np.searchsorted(slots, row("at") * t + at) * p + of, return_inverse=True)
            phase = b["phase"].flatten().to_numpy(zero_copy_only=False)
            many, c, s = (np.bincount(inverse, w, len(keys)) for w in (None, np.cos(phase), np.sin(phase)))
            keys, many, c, s = np.append(keys, -1), np.append(many, 0), np.append(c, 0.0), np.append(s, 0.0)
            groups, g = np.unique(g, return_inverse=True)
            pairs, pair = np.unique(g * len(slots) + slot, return_inverse=True)
            # orders of one row: its shuffles one after another, each with all its trials
            place = np.searchsorted(slots, owner * t + order)
            sizes = np.bincount(owner, minlength=b.num_rows) // draws
            first = np.cumsum(sizes * draws) - sizes * draws
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            size, begin = np.repeat(sizes, sizes), np.repeat(first, sizes)
            target = np.empty(len(slots), np.int64)
            more = b["more"].to_numpy(zero_copy_only=False).astype(bool)[groups // len(units)]
            for k in range(draws):
                lo = begin + k * size
                target[place[lo + within]] = place[lo + (within - turn) % size]
                wanted = target[slot] * p + i
                hit = np.searchsorted(keys[:-1], wanted)
                hit = np.where(keys[hit] == wanted, hit, len(keys) - 1)
                n, x, y = (np.bincount(g, w[hit], len(groups)) for w in (many, c, s))
                used = np.unique(pair[many[hit] > 0])
                trials = np.bincount(pairs[used] // len(slots), minlength=len(groups))
                ends = np.cumsum(np.where(more, trials, 0))
                source = names.take(pa.array(slots[(pairs[used] % len(slots))[more[pairs[used] // len(slots)]]] % t))
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), source)
                found = n > 0
                cells = [b[group].take(pa.array(groups // len(units))), units.take(pa.array(groups % len(units))), pa.array(np.full(len(groups), k, np.int32)), pa.array(n.astype(np.int64)), pa.array(x), pa.array(y), pa.array(np.where(more, 0, trials)), listed]
                yield pa.RecordBatch.from_arrays(cells, [group, "unit", "shuffle", "n", "c", "s", "trials", "sources"]).filter(pa.array(found))

    trial = dict(met.dtypes)["trial"]
    laid = met.where(F.size("trials") > turn).withColumn("_o", orders).select(group, "trial", "i", "unit", "at", "of", "phase", "more", F.flatten("_o").alias("orders"), F.size("_o").alias("shuffles"))
    each = laid.mapInArrow(run, f"`{group}` {kind}, unit {unit}, shuffle int, n bigint, c double, s double, trials bigint, sources {trial}")
    # a trial can meet in several stretches, so there its trials are told by name
    return each.groupBy(group, "unit", "shuffle").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"), (F.sum("trials") + F.size(F.array_distinct(F.flatten(F.collect_list("sources"))))).alias("trials"))


def shuffle_null(spikes: DataFrame, phases: DataFrame, shuffles: int, group: str = "session", width: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The observed consistency (group, unit, n, trials, ppc), and that of each shuffle (group, unit, shuffle, n, trials, ppc).

    Shuffles are those of `derangements`. Tasks hold a group's spikes and phases of `width` places i at a time.
    """
    unit = dict(spikes.dtypes)["unit"]
    met = _met(spikes, phases, group, width)
    ordered = lambda k: F.transform(F.array_sort(F.transform("trials", lambda t: F.struct(F.xxhash64(t, k, F.lit(17)).alias("h"), t.alias("t")))), lambda v: v["t"])
    drawn = F.transform(F.sequence(F.lit(0), F.lit(shuffles - 1)), ordered)
    n, power = F.col("n"), F.col("c") * F.col("c") + F.col("s") * F.col("s")
    sums = lambda orders, turn: _edge_sums(met, orders, turn, group, unit).select(group, "unit", "shuffle", "n", "trials", F.when(n >= 2, (power - n) / (n * (n - 1))).alias("ppc"))
    return sums(F.array("trials"), 0).drop("shuffle"), sums(drawn, 1)


def permutation_p(observed: DataFrame, null: DataFrame, keys: Sequence[str], least: int = 50, statistic: str = "ppc") -> DataFrame:
    """p = (1 + draws at or over the observed) / (1 + draws) with mean and deviation of the draws; null for units with
    under `least` points, fewer than two trials, no statistic, or no draw."""
    draws = null.where(F.col(statistic).isNotNull()).select(*keys, F.col(statistic).alias("_d"))
    joined = observed.join(draws, list(keys), "left").groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("trials").alias("trials"), F.first(statistic).alias(statistic), F.count("_d").alias("draws"),
        F.count_if(F.col("_d") >= F.col(statistic)).alias("_over"), F.avg("_d").alias("null_mean"), F.stddev_samp("_d").alias("null_sd"),
    )
    ok = (F.col("n") >= least) & (F.col("trials") >= 2) & F.col(statistic).isNotNull() & (F.col("draws") > 0)
    return joined.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("p", F.when(F.col("eligible"), (1 + F.col("_over")) / (1 + F.col("draws")))).drop("_over")


def prevalence(rows: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """By key the share of eligible units whose q is under alpha."""
    hit = F.coalesce(F.col("q") < alpha, F.lit(False))
    out = rows.groupBy(*keys).agg(F.count_if("eligible").alias("n_eligible"), F.count_if(F.col("eligible") & hit).alias("n_significant"))
    return out.withColumn("prevalence", F.try_divide(F.col("n_significant").cast("double"), F.col("n_eligible")))


def unit_order(rows: DataFrame, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """Units (unit, f, ppc) by their mean consistency over low <= f <= high, largest first, units without one last, then by unit."""
    mean = rows.groupBy(*keys, "unit").agg(F.avg(F.when(F.col("f").between(low, high), F.col("ppc"))).alias("mean_ppc"))
    w = Window.partitionBy(*keys).orderBy(F.col("mean_ppc").desc_nulls_last(), "unit")
    return mean.withColumn("place", F.row_number().over(w))


def population_median(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By key the median consistency of reliable units, and how many they are."""
    x = F.when(F.col("reliable"), F.col("ppc"))
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.percentile(x, F.lit(0.5)).alias("median_ppc"))
