"""Sampled signals: kernels over samples, wavelets, coherence, synchrony, traces, pulses, time codes, barcodes.

Samples are (series, i, v) with i counting from 0 without gaps. A kernel reaches over neighbouring samples through a
join on their chunk: every sample goes to its own chunk and, near an edge, to the one beside it, so that a long series
is many tasks and no window holds it whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranks import quantiles

TAU = 2 * math.pi


def convolve(samples: DataFrame, kernels: dict[str, np.ndarray], chunk: int = 8192, columns: dict[str, str] | None = None) -> DataFrame:
    """Series, i, v and for each named kernel (odd length, all real or all complex) the centred sum of neighbours
    times its weights, conjugated; complex kernels give <name>_re and <name>_im. Beyond the ends there is nothing.
    `columns` names what a kernel is to be laid on where that is not v."""
    columns = columns or {}
    used = sorted({"v", *columns.values()})
    half = max(len(k) for k in kernels.values()) // 2
    if half >= chunk:
        raise ValueError("chunk must be longer than half a kernel")
    own = F.floor(F.col("i") / chunk)
    at = F.col("i") % chunk
    near = F.array_compact(F.array(own, F.when((at < half) & (own > 0), own - 1), F.when(at >= chunk - half, own + 1)))
    names = [c for n, k in kernels.items() for c in ([f"{n}_re", f"{n}_im"] if np.iscomplexobj(k) else [n])]
    dealt = samples.select("series", "i", *[F.col(c).cast("double").alias(c) for c in used], F.explode(near).alias("chunk"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        mine = (p["i"] // chunk == p["chunk"]).to_numpy()
        out = {}
        for n, k in kernels.items():
            y = np.convolve(p[columns.get(n, "v")].to_numpy(), np.conj(k)[::-1])[len(k) // 2 : len(k) // 2 + len(p)]
            out |= {f"{n}_re": y.real, f"{n}_im": y.imag} if np.iscomplexobj(k) else {n: y}
        return p.assign(**out)[["series", "i", "v", *names]][mine]

    kind = dict(samples.dtypes)["series"]
    return dealt.groupBy("series", "chunk").applyInPandas(run, f"series {kind}, i bigint, v double, " + ", ".join(f"{n} double" for n in names))


def sinc_kernel(half: int, cutoff: float) -> np.ndarray:
    """Low-pass weights (cutoff in cycles a sample) of a Hann-windowed sinc of 2 * half + 1 samples; they add up to 1."""
    t = np.arange(-half, half + 1)
    k = 2 * cutoff * np.sinc(2 * cutoff * t) * (0.5 + 0.5 * np.cos(np.pi * t / (half + 1)))
    return k / k.sum()


def bandpass_kernel(half: int, low: float, high: float) -> np.ndarray:
    """The difference of two low-passes: zero phase, zero mean."""
    return sinc_kernel(half, high) - sinc_kernel(half, low)


def notch_kernel(half: int, centre: float, width: float) -> np.ndarray:
    """All but the band of `width` around `centre`."""
    k = -bandpass_kernel(half, centre - width / 2, centre + width / 2)
    k[half] += 1
    return k


def morlet_kernel(frequency: float, rate: float, cycles: float = 6.0, reach: float = 3.0) -> np.ndarray:
    """Complex wavelet of `cycles` cycles at `frequency`, out to `reach` deviations, its Gaussian adding up to 1."""
    sd = cycles / (TAU * frequency) * rate
    t = np.arange(-math.ceil(reach * sd), math.ceil(reach * sd) + 1)
    g = np.exp(-0.5 * (t / sd) ** 2)
    return g / g.sum() * np.exp(1j * TAU * frequency / rate * t)


def wavelets(samples: DataFrame, frequencies: Sequence[float], rate: float, cycles: float = 6.0, floor: float = 1e-12, chunk: int = 8192) -> DataFrame:
    """Series, i, f, re, im, power (log10 of the squared modulus, null below the floor), and unit phase cr, ci, null
    where the modulus is under the floor or the wavelet reaches over an end of the series."""
    kernels = {f"f{n}": morlet_kernel(f, rate, cycles) for n, f in enumerate(frequencies)}
    rows = convolve(samples, kernels, chunk)
    last = samples.groupBy("series").agg(F.max("i").alias("_last"))
    each = [F.struct(F.lit(float(f)).alias("f"), F.lit(len(kernels[f"f{n}"]) // 2).alias("half"), F.col(f"f{n}_re").alias("re"), F.col(f"f{n}_im").alias("im")) for n, f in enumerate(frequencies)]
    rows = rows.select("series", "i", F.inline(F.array(*each))).join(last, "series")
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    ok = (size >= floor) & (F.col("i") >= F.col("half")) & (F.col("i") + F.col("half") <= F.col("_last"))
    power = F.when(size >= floor, 2 * F.log10(size))
    return rows.select("series", "i", "f", "re", "im", power.alias("power"), F.when(ok, F.col("re") / size).alias("cr"), F.when(ok, F.col("im") / size).alias("ci"))


def relative_phase(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two sites' coefficients (trial, f, i, re, im): the phase of a less that of b, and both moduli; rows that either lacks, or where a modulus is 0, are null or absent."""
    both = a.select("trial", "f", "i", F.col("re").alias("ar"), F.col("im").alias("ai")).join(b.select("trial", "f", "i", F.col("re").alias("br"), F.col("im").alias("bi")), ["trial", "f", "i"])
    re, im = F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"), F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")
    size = lambda x: F.sqrt(F.col(f"{x}r") * F.col(f"{x}r") + F.col(f"{x}i") * F.col(f"{x}i"))
    return both.select("trial", "f", "i", F.when(size("a") * size("b") > 0, F.atan2(im, re)).alias("phase"), size("a").alias("amplitude_a"), size("b").alias("amplitude_b"))


def trial_plv(phases: DataFrame, keys: Sequence[str], least: int = 2, share: float = 0.8) -> DataFrame:
    """By key (trial, epoch, frequency) from relative phases (null where not valid): n, valid, PLV, pairwise phase
    consistency and mean offset; null with under `least` valid samples or under `share` of them valid."""
    out = phases.groupBy(*keys).agg(F.count("*").alias("n"), F.count("phase").alias("valid"), F.sum(F.cos("phase")).alias("c"), F.sum(F.sin("phase")).alias("s"))
    m, power = F.col("valid"), F.col("c") * F.col("c") + F.col("s") * F.col("s")
    ok = (m >= least) & (m >= share * F.col("n"))
    return out.select(*keys, "n", "valid", F.when(ok, F.sqrt(power) / m).alias("plv"), F.when(ok & (m > 1), (power - m) / (m * (m - 1))).alias("ppc"), F.when(ok, F.atan2("s", "c")).alias("offset"))


def support_mask(phases: DataFrame, low: float, *keys: str) -> DataFrame:
    """Adds supported: both amplitudes at or over their `low` quantile by key."""
    q = lambda c: F.percentile(c, F.lit(low))
    edge = phases.groupBy(*keys).agg(q("amplitude_a").alias("_qa"), q("amplitude_b").alias("_qb"))
    return phases.join(edge, list(keys)).withColumn("supported", (F.col("amplitude_a") >= F.col("_qa")) & (F.col("amplitude_b") >= F.col("_qb"))).drop("_qa", "_qb")


def site_coherence(a: DataFrame, b: DataFrame) -> DataFrame:
    """ISPC of unit phases (trial, f, i, cr, ci) of two sites over trials, by f and i: trials where either is null do not count."""
    both = a.select("trial", "f", "i", F.col("cr").alias("ar"), F.col("ci").alias("ai")).join(b.select("trial", "f", "i", F.col("cr").alias("br"), F.col("ci").alias("bi")), ["trial", "f", "i"]).where("ar IS NOT NULL AND br IS NOT NULL")
    re, im = F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")), F.sum(F.col("ai") * F.col("br") - F.col("ar") * F.col("bi"))
    return both.groupBy("f", "i").agg(F.count("*").alias("n"), (F.sqrt(re * re + im * im) / F.count("*")).alias("ispc"))


def segment_spectra(samples: DataFrame, size: int) -> DataFrame:
    """The Fourier sums (series, segment, f, re, im) of Hann-windowed, half overlapping segments of `size` samples less their mean."""
    half = size // 2
    last = samples.groupBy("series").agg(F.max("i").alias("_last"))
    s = F.floor(F.col("i") / half)
    rows = samples.withColumn("segment", F.explode(F.array(s, s - 1))).where("segment >= 0").join(last, "series").where(F.col("segment") * half + size - 1 <= F.col("_last"))
    rows = rows.withColumn("_k", F.col("i") - F.col("segment") * half).withColumn("_d", F.col("v") - F.avg("v").over(Window.partitionBy("series", "segment")))
    turn = TAU * F.col("_k") / size
    rows = rows.withColumn("_x", F.col("_d") * (0.5 - 0.5 * F.cos(turn))).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(half))))
    return rows.groupBy("series", "segment", "f").agg(F.sum(F.col("_x") * F.cos(turn * F.col("f"))).alias("re"), F.sum(F.col("_x") * -F.sin(turn * F.col("f"))).alias("im"))


def coherence(a: DataFrame, b: DataFrame, rate: float, size: int) -> DataFrame:
    """|Sxy|^2 / (Sxx Syy) of two signals by series (trial) and frequency, averaged over segments; null where a power is 0, above 1 by rounding is 1."""
    x, y = segment_spectra(a, size), segment_spectra(b, size).withColumnsRenamed({"re": "br", "im": "bi"})
    both = x.join(y, ["series", "segment", "f"])
    sums = both.groupBy("series", "f").agg(
        F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("xx"), F.sum(F.col("br") * F.col("br") + F.col("bi") * F.col("bi")).alias("yy"),
        F.sum(F.col("re") * F.col("br") + F.col("im") * F.col("bi")).alias("xr"), F.sum(F.col("im") * F.col("br") - F.col("re") * F.col("bi")).alias("xi"), F.count("*").alias("segments"),
    )
    value = F.try_divide(F.col("xr") * F.col("xr") + F.col("xi") * F.col("xi"), F.col("xx") * F.col("yy"))
    return sums.select("series", "f", (F.col("f") * rate / size).alias("frequency"), "segments", F.least(value, F.when(value.isNotNull(), 1.0)).alias("coherence"))


def reference_spectrum(spectra: DataFrame, valid: str | None = None) -> DataFrame:
    """F, reference: the median over trials of the densities (series, f, density), of those rows alone where the column
    `valid` is true; null densities do not count, and a frequency without any has no row. Ranges of density, not a
    frequency, are a task's share."""
    rows = spectra.where(F.col(valid)) if valid else spectra
    return quantiles(rows.where(~F.isnan("density")), ["f"], "density", [0.5]).withColumnRenamed("q0", "reference")


def spectrum_levels(spectra: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds to (series, f, density) the reference (f, reference) and db over it, null where either is null, 0 or not finite.

    The reference has a row a frequency, so it is small whatever the trials are.
    """
    fine = lambda c: (F.col(c) > 0) & (F.col(c) < math.inf)
    met = spectra.join(F.broadcast(reference.select("f", "reference")), "f", "left")
    return met.withColumn("db", F.when(fine("density") & fine("reference"), 10 * F.log10(F.col("density") / F.col("reference"))))


def quartiles(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """By key (few, of many rows) how many values there are, their median, and 25th and 75th percentile; nulls and NaN do not count."""
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = held.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(quantiles(held, keys, value, [0.5, 0.25, 0.75]).withColumnsRenamed({"q0": "median", "q1": "low", "q2": "high"}), list(keys))


def running_median(samples: DataFrame, half: int = 3, pad: bool = True) -> DataFrame:
    """The median of 2 * half + 1 samples; beyond the ends the end's own value counts again (`pad`), or windows are cut."""
    w = Window.partitionBy("series").orderBy("i")
    values = F.collect_list("v").over(w.rowsBetween(-half, half))
    if pad:
        here, back = F.row_number().over(w) - 1, F.row_number().over(Window.partitionBy("series").orderBy(F.desc("i"))) - 1
        rows = samples.withColumn("_l", F.greatest(half - here, F.lit(0))).withColumn("_r", F.greatest(half - back, F.lit(0))).withColumn("_v", values)
        rows = rows.withColumn("_v", F.concat(F.array_repeat(F.get("_v", F.lit(0)), F.col("_l")), F.col("_v"), F.array_repeat(F.element_at("_v", -1), F.col("_r"))))
    else:
        rows = samples.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(0)).withColumn("_v", values)
    rows = rows.withColumn("_v", F.array_sort("_v")).withColumn("_n", F.size("_v"))
    middle = (F.get("_v", F.floor((F.col("_n") - 1) / 2).cast("int")) + F.get("_v", F.floor(F.col("_n") / 2).cast("int"))) / 2
    return rows.withColumn("median", middle).drop("_l", "_r", "_v", "_n")


def _levels(rows: DataFrame, on: str) -> DataFrame:
    """Maximal runs of a 0/1 column: series, run, level, start, stop (exclusive), n."""
    w = Window.partitionBy("series").orderBy("i")
    new = (~F.col(on).eqNullSafe(F.lag(on).over(w))).cast("int")
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("series", "run").agg(F.first(on).alias("level"), F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).withColumn("n", F.col("stop") - F.col("start"))


def drop_short(rows: DataFrame, on: str, level: int, least: int, inner: bool = False) -> DataFrame:
    """The 0/1 column with runs of `level` under `least` samples turned over; with `inner`, only runs between two others."""
    runs = _levels(rows.select("series", "i", on), on)
    w = Window.partitionBy("series").orderBy("run")
    inside = F.lead("run").over(w).isNotNull() & F.lag("run").over(w).isNotNull() if inner else F.lit(True)
    flip = runs.withColumn("_f", (F.col("level") == level) & (F.col("n") < least) & inside).where("_f").select("series", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"), F.lit(1).alias("_f"))
    return rows.join(flip, ["series", "i"], "left").withColumn(on, F.when(F.col("_f") == 1, 1 - F.col(on)).otherwise(F.col(on))).drop("_f")


def extract_pulses(samples: DataFrame, half: int = 25, least: int = 3, gap: int = 3) -> DataFrame:
    """Pulses (series, start, stop, n) of a noisy line: over the running median by three robust deviations on, by one
    and a half off; short pulses dropped, short inner gaps filled, short pulses dropped again."""
    rows = running_median(samples, half).withColumn("_r", F.col("v") - F.col("median"))
    spread = rows.groupBy("series").agg(F.percentile("_r", F.lit(0.5)).alias("_m"))
    rows = rows.join(spread, "series")
    mad = rows.groupBy("series").agg((F.percentile(F.abs(F.col("_r") - F.col("_m")), F.lit(0.5)) * 1.4826 + 1e-12).alias("_sd"))
    rows = rows.join(mad, "series")
    mark = F.when(F.col("_r") >= 3 * F.col("_sd"), 1).when(F.col("_r") <= 1.5 * F.col("_sd"), 0)
    w = Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("series", "i", F.coalesce(F.last(mark, True).over(w), F.lit(0)).alias("is_on"))
    rows = drop_short(drop_short(drop_short(rows, "is_on", 1, least), "is_on", 0, gap, True), "is_on", 1, least)
    return _levels(rows, "is_on").where("level = 1").select("series", "start", "stop", "n")


def debounce(transitions: DataFrame, least: float) -> DataFrame:
    """Transitions (line, t, state) with pulses shorter than `least` taken away again and again, then repeats of a state.

    One ordered pass with a stack: a transition within `least` of the one that stands takes that one away with itself,
    which leaves the state before both. Lines come sorted and in batches; a task holds what stands of one batch's lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, last, level = None, None, None
        for b in batches:
            out = []
            for k, t, s in zip(b["line"], b["t"], b["state"], strict=True):
                if k != line:
                    if last is not None:
                        out.append((line, *last))
                    line, last, level = k, None, None
                if last is not None and t - last[0] < least:
                    last = None  # the pulse between them goes; what stands is the state before it
                    if s != level:
                        last = (t, s)
                    continue
                if last is not None:
                    out.append((line, *last))
                    level = last[1]
                last = (t, s) if s != level else None
            yield pd.DataFrame(out, columns=["line", "t", "state"]).astype({"line": b["line"].dtype, "t": "float64", "state": "int32"})
        if last is not None:
            yield pd.DataFrame([(line, *last)], columns=["line", "t", "state"])

    rows = transitions.select("line", F.col("t").cast("double").alias("t"), F.col("state").cast("int").alias("state")).repartition("line").sortWithinPartitions("line", "t")
    return rows.mapInPandas(run, f"line {dict(transitions.dtypes)['line']}, t double, state int")


def voltage_to_speed(samples: DataFrame, gain: float, offset: float = 0.0, column: str = "v") -> DataFrame:
    """speed = (v - offset) * gain."""
    return samples.withColumn("speed", (F.col(column) - offset) * gain)


def trial_traces(samples: DataFrame, centres: DataFrame, low: float, high: float, step: float, rate: float) -> DataFrame:
    """By centre (series, ref, t0 in seconds) the samples between low and high on a grid of `step` seconds, each grid
    point on the line between its two samples: series, ref, k, v; a point beyond the samples is null."""
    n = round((high - low) / step)
    grid = centres.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_x", (F.col("t0") + low + F.col("k") * step) * rate)
    grid = grid.withColumn("_i", F.floor("_x")).withColumn("_w", F.col("_x") - F.col("_i"))
    both = grid.withColumn("_p", F.explode(F.array(F.struct(F.col("_i").alias("i"), (1 - F.col("_w")).alias("w")), F.struct((F.col("_i") + 1).alias("i"), F.col("_w").alias("w"))))).select("series", "ref", "k", "_p.i", "_p.w").where("w > 0")
    got = both.join(samples.select("series", "i", "v"), ["series", "i"], "left")
    out = got.groupBy("series", "ref", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.count("v").alias("_n"), F.count("*").alias("_m"))
    return out.select("series", "ref", "k", F.when(F.col("_n") == F.col("_m"), F.col("v")).alias("v"))


def trace_quality(traces: DataFrame) -> DataFrame:
    """By trace: root mean square, peak to peak, and reason: incomplete or constant."""
    out = traces.groupBy("series", "ref").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), (F.max("v") - F.min("v")).alias("peak_to_peak"), F.count("v").alias("_n"), F.count("*").alias("_m"))
    return out.withColumn("reason", F.when(F.col("_n") < F.col("_m"), "incomplete").when(F.col("peak_to_peak") == 0, "constant")).drop("_n", "_m")


def bootstrap_mean(rows: DataFrame, keys: Sequence[str], value: str, row_id: str, draws: int = 200, few: int = 10) -> DataFrame:
    """Mean with the 2.5th and 97.5th percentile of `draws` resampled means by key, and unstable with under `few` rows.

    A row stands in a draw as often as a Poisson(1) count from a hash of its id and the draw says: no draw is drawn twice
    and reruns agree. Draws without a row do not count.
    """
    u = F.pmod(F.xxhash64(F.col(row_id), F.col("draw"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    times = sum(((u >= float(c)).cast("int") for c in cuts), F.lit(0))
    data = rows.where(F.col(value).isNotNull())
    drawn = data.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_c", times)
    means = drawn.groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("_c") * F.col(value)), F.sum("_c")).alias("_m"))
    ci = means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return data.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(ci, list(keys)).withColumn("unstable", F.col("n") < few)


def lowess(samples: DataFrame, half: int = 15, passes: int = 2, chunk: int = 8192) -> DataFrame:
    """Baseline of a local line with tricube weights over 2 * half + 1 samples (cut at the ends), made robust by
    `passes` further fits with bisquare weights of the residuals, and detrended = v - baseline.

    Each pass is one shuffle for five kernel sums; the scale of the residuals is their median by series.
    """
    t = np.arange(-half, half + 1)
    tri = (1 - np.abs(t / (half + 1)) ** 3) ** 3
    kernels = {"s0": tri, "s1": tri * t, "s2": tri * t**2, "y0": tri, "y1": tri * t}
    on = {"s0": "w", "s1": "w", "s2": "w", "y0": "y", "y1": "y"}
    rows = samples.select("series", "i", F.col("v").cast("double").alias("v"), F.lit(1.0).alias("w"))
    for n in range(passes + 1):
        sums = convolve(rows.withColumn("y", F.col("w") * F.col("v")), kernels, chunk, on)
        base = F.try_divide(F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1"), F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
        rows = sums.select("series", "i", "v", F.coalesce(base, F.try_divide("y0", "s0"), F.col("v")).alias("baseline")).withColumn("detrended", F.col("v") - F.col("baseline"))
        if n < passes:
            scale = rows.groupBy("series").agg((6 * F.percentile(F.abs("detrended"), F.lit(0.5))).alias("_s"))
            u = F.try_divide(F.col("detrended"), F.col("_s"))
            rows = rows.join(scale, "series").withColumn("w", F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(F.when(u.isNull(), 1.0).otherwise(0.0)))
    return rows.select("series", "i", "v", "baseline", "detrended")


def pulse_classes(pulses: DataFrame, period: float = 1.0) -> DataFrame:
    """Pulses (line, t, width) by their share of the period: over 0.75 marker, over 0.45 one, over 0.05 zero, else unknown."""
    x = F.col("width") / period
    return pulses.withColumn("kind", F.when(x > 0.75, "marker").when(x > 0.45, "one").when(x > 0.05, "zero").otherwise("unknown"))


# Fixed values of the public IRIG-B time code: places of the position markers in a frame of 60 pulses, and of the binary
# coded decimal weights of minutes, hours and days by place.
MARKERS = (0, 9, 19, 29, 39, 49, 59)
MINUTES = {10: 1, 11: 2, 12: 4, 13: 8, 15: 10, 16: 20, 17: 40}
HOURS = {20: 1, 21: 2, 22: 4, 23: 8, 25: 10, 26: 20}
DAYS = {30: 1, 31: 2, 32: 4, 33: 8, 35: 10, 36: 20, 37: 40, 38: 80, 40: 100, 41: 200}
YEARS = {50: 1, 51: 2, 52: 4, 53: 8, 55: 10, 56: 20, 57: 40, 58: 80}


def time_code_frames(pulses: DataFrame) -> DataFrame:
    """Frames (line, t, utc) of classified pulses (line, t, kind), one pulse a second, 60 a frame.

    A frame starts at a marker that follows another, and holds markers in just the marker places; utc is null where the
    coded day is none. Each candidate sees the 59 pulses after it by a window, whatever the line's length.
    """
    w = Window.partitionBy("line").orderBy("t")
    rows = pulses.withColumn("_was", F.lag("kind").over(w)).withColumn("_k", F.collect_list("kind").over(w.rowsBetween(0, 59)))
    rows = rows.where((F.col("kind") == "marker") & (F.col("_was").isNull() | (F.col("_was") == "marker")) & (F.size("_k") == 60))
    at = lambda i: F.get("_k", F.lit(i))
    good = F.lit(True)
    for i in range(60):
        good = good & ((at(i) == "marker") if i in MARKERS else at(i).isin("one", "zero"))
    number = lambda bits: sum((F.when(at(i) == "one", v).otherwise(0) for i, v in bits.items()), F.lit(0))
    rows = rows.where(good).select("line", "t", number(MINUTES).alias("minute"), number(HOURS).alias("hour"), number(DAYS).alias("day"), (2000 + number(YEARS)).alias("year"))
    length = F.when((F.col("year") % 4 == 0) & ((F.col("year") % 100 != 0) | (F.col("year") % 400 == 0)), 366).otherwise(365)
    ok = (F.col("minute") < 60) & (F.col("hour") < 24) & F.col("day").between(1, length)
    midnight = (F.unix_date(F.make_date("year", F.lit(1), F.lit(1))) + F.col("day") - 1).cast("bigint")
    return rows.select("line", "t", F.when(ok, midnight * 86400 + F.col("hour") * 3600 + F.col("minute") * 60).cast("bigint").alias("utc"))


def pulse_times(pulses: DataFrame, frames: DataFrame) -> DataFrame:
    """Utc seconds of every pulse (line, t): the latest frame's with a known time, and one second a pulse since; null before the first."""
    w = Window.partitionBy("line").orderBy("t")
    rows = pulses.join(frames.where("utc IS NOT NULL").select("line", "t", "utc"), ["line", "t"], "left").withColumn("_n", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("utc").isNotNull(), F.struct("utc", "_n")), True).over(upto)
    return rows.withColumn("_a", anchor).withColumn("utc", F.col("_a.utc") + F.col("_n") - F.col("_a._n")).drop("_a", "_n")


def barcodes(transitions: DataFrame, slot: float = 0.03, wrapper: float = 0.01, bits: int = 32, tolerance: float = 0.2) -> DataFrame:
    """Barcodes (line, t, code) of transitions (line, t, state): four high pulses of `wrapper` seconds, then `bits`
    slots of `slot` seconds, the most significant first. A slot's bit is the level at its middle: that of the last edge, so
    that it keeps the level where no edge falls near its start. Without just four wrapper pulses there is no code.
    """
    w = Window.partitionBy("line").orderBy("t")
    rows = transitions.withColumn("_next", F.lead("t").over(w))
    near = F.abs(F.col("_next") - F.col("t") - wrapper) <= wrapper * tolerance
    rows = rows.withColumn("_wrap", F.coalesce((F.col("state") == 1) & near, F.lit(False)))
    pulses = rows.where("_wrap").withColumn("_p", F.lag("t").over(w)).withColumn("_new", F.coalesce((F.col("t") - F.col("_p") > 4 * wrapper).cast("int"), F.lit(1)))
    pulses = pulses.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = pulses.groupBy("line", "_g").agg(F.count("*").alias("_n"), F.min("t").alias("begin"), F.max("_next").alias("end")).where("_n = 4")
    slots = starts.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).select("line", (F.col("end") + (F.col("bit") + 0.5) * slot).alias("t"), "begin", "bit")
    both = slots.unionByName(transitions.select("line", "t", "state"), allowMissingColumns=True)
    level = F.last("state", True).over(Window.partitionBy("line").orderBy("t", F.col("bit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    read = both.withColumn("_l", F.coalesce(level, F.lit(0))).where("bit IS NOT NULL")
    code = F.sum(F.col("_l").cast("bigint") * F.pow(F.lit(2.0), bits - 1 - F.col("bit")).cast("bigint"))
    return read.groupBy("line", F.col("begin").alias("t")).agg(code.alias("code"))

