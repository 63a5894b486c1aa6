"""Features of signal windows, native over samples and arrays.

`windows` has one row per window: id columns and x, an array of doubles. `samples` is the same exploded: id, i, x.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The eight taps of the Daubechies wavelet with four vanishing moments, decomposition low-pass.
DB4 = [-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523]


def samples(windows: DataFrame, key: str) -> DataFrame:
    return windows.select(key, F.posexplode("x").alias("i", "x"))


def usable(windows: DataFrame, flat: float = 1e-9) -> DataFrame:
    """Adds reason: why a window can't be used (`missing`, `not finite`, `flat`), or null."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    empty = F.col("x").isNull() | (F.size("x") == 0)
    reason = F.when(empty, "missing").when(bad, "not finite").when(F.array_max("x") - F.array_min("x") < flat, "flat")
    return windows.withColumn("reason", reason)


def decimate(x: Column, most: int) -> Column:
    """Every ceil(n / most)-th value."""
    step = F.ceil(F.size(x) / F.lit(most)).cast("int")
    return F.filter(x, lambda _, i: i % step == 0)


def moments(s: DataFrame, key: str) -> DataFrame:
    """(key, kur, ske): excess kurtosis and skewness with population moments."""
    return s.groupBy(key).agg(F.kurtosis("x").alias("kur"), F.skewness("x").alias("ske"))


def hjorth(s: DataFrame, key: str) -> DataFrame:
    """(key, sm, sc): mobility sqrt(var dx / var x) and complexity, the mobility of dx over that of x."""
    order = Window.partitionBy(key).orderBy("i")
    d = s.withColumn("d", F.col("x") - F.lag("x").over(order)).withColumn("dd", F.col("d") - F.lag("d").over(order))
    v = d.groupBy(key).agg(*[F.nullif(F.var_pop(c), F.lit(0.0)).alias(f"v_{c}") for c in ("x", "d", "dd")])
    mobility = F.sqrt(F.col("v_d") / F.col("v_x"))
    return v.select(key, mobility.alias("sm"), (F.sqrt(F.col("v_dd") / F.col("v_d")) / mobility).alias("sc"))


def amplitude_entropy(s: DataFrame, key: str, bins: int = 64) -> DataFrame:
    """(key, se): Shannon entropy in bits over equal bins from least to greatest value, the last one closed."""
    ends = s.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(bins // 2)
    counts = s.join(ends, key).groupBy(key, place.alias("b"), "n").agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return counts.groupBy(key).agg((-F.sum(p * F.log2(p))).alias("se"))


def spectrum(s: DataFrame, key: str, n: int) -> DataFrame:
    """(key, k, re, im, n_k): components 0 to n / 2 of windows of n samples, by a join with a table of n phases times
    each component; n_k is how many of the n components it stands for."""
    spark = s.sparkSession
    waves = spark.range(n // 2 + 1).select(F.col("id").alias("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = 2 * math.pi / n * ((F.col("k") * F.col("i")) % n)
    waves = waves.select("k", "i", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    both = s.join(F.broadcast(waves), "i").groupBy(key, "k").agg(F.sum(F.col("x") * F.col("c")).alias("re"), (-F.sum(F.col("x") * F.col("s"))).alias("im"))
    return both.withColumn("n_k", F.when((F.col("k") == 0) | ((F.lit(n % 2) == 0) & (F.col("k") == n // 2)), 1).otherwise(2))


def spectral_entropy(spec: DataFrame, key: str, n: int) -> DataFrame:
    """(key, pse): entropy of the one-sided periodogram without the mean, inner components twice, over the log of their
    number."""
    power = spec.withColumn("p", F.when(F.col("k") == 0, 0.0).otherwise((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.col("n_k")))
    share = power.withColumn("q", F.col("p") / F.nullif(F.sum("p").over(Window.partitionBy(key)), F.lit(0.0)))
    return share.groupBy(key).agg((-F.sum(F.when(F.col("q") > 0, F.col("q") * F.log2("q")).otherwise(0.0)) / math.log2(n // 2 + 1)).alias("pse"))


def c0_complexity(spec: DataFrame, key: str, n: int) -> DataFrame:
    """(key, c0): share of energy in components whose power isn't above the mean power; 0 without energy."""
    power = spec.withColumn("p", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    mean = F.sum(F.col("p") * F.col("n_k")).over(Window.partitionBy(key)) / n
    parts = power.withColumn("low", F.when(F.col("p") > mean, 0.0).otherwise(F.col("p") * F.col("n_k")))
    return parts.groupBy(key).agg(F.coalesce(F.sum("low") / F.nullif(F.sum(F.col("p") * F.col("n_k")), F.lit(0.0)), F.lit(0.0)).alias("c0"))


def higuchi(s: DataFrame, key: str, kmax: int = 10) -> DataFrame:
    """(key, fd): Higuchi's dimension, the slope of log L(k) on log(1 / k) for k to kmax."""
    n = F.count("*").over(Window.partitionBy(key))
    order = Window.partitionBy(key).orderBy("i")
    lagged = s.select("*", n.alias("n"), *[F.abs(F.col("x") - F.lag("x", k).over(order)).alias(f"d{k}") for k in range(1, kmax + 1)])
    steps = lagged.select(key, "i", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("d")) for k in range(1, kmax + 1)])).alias("e"))
    rows = steps.select(key, "n", F.col("e.k").alias("k"), F.col("e.d").alias("d"), (F.col("i") % F.col("e.k")).alias("m")).where("d is not null")
    length = rows.groupBy(key, "k", "m", "n").agg(F.sum("d").alias("d"), F.count("*").alias("c"))
    lm = length.withColumn("l", F.col("d") * (F.col("n") - 1) / (F.col("c") * F.col("k") * F.col("k")))
    lk = lm.groupBy(key, "k").agg(F.avg("l").alias("l")).where("l > 0")
    return lk.groupBy(key).agg(F.regr_slope(F.log("l"), F.log(1 / F.col("k"))).alias("fd"))


def _embedded(s: DataFrame, key: str, m: int) -> DataFrame:
    """(key, i, v): every m values in a row."""
    order = Window.partitionBy(key).orderBy("i")
    return s.withColumn("v", F.array(*[F.lead("x", j).over(order) for j in range(m)])).where(F.expr("not exists(v, y -> y is null)")).select(key, "i", "v")


def _pairs_within(e: DataFrame, key: str) -> DataFrame:
    """Pairs i < j of one window's vectors with their greatest difference; windows are short, so pairs are bounded."""
    a, b = e.select(key, "i", F.col("v").alias("a")), e.select(key, F.col("i").alias("j"), F.col("v").alias("b"))
    return a.join(b, key).where("i < j").withColumn("d", F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))))


def sample_entropy(s: DataFrame, key: str, m: int = 2, r: float = 0.2) -> DataFrame:
    """(key, ke): -ln(A / B), pairs of m + 1 values over pairs of m values within r population deviations; 0 if either
    is 0. Both count the templates that have a value after them."""
    limit = s.groupBy(key).agg((r * F.stddev_pop("x")).alias("r"))
    e = _embedded(s, key, m + 1)
    pairs = _pairs_within(e.withColumn("v", F.slice("v", 1, m)), key).select(key, "i", "j", "d")
    more = _pairs_within(e, key).select(key, "i", "j", F.col("d").alias("d1"))
    both = pairs.join(more, [key, "i", "j"]).join(limit, key)
    n = both.groupBy(key).agg(F.sum((F.col("d") <= F.col("r")).cast("long")).alias("b"), F.sum((F.col("d1") <= F.col("r")).cast("long")).alias("a"))
    return n.select(key, F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b"))).otherwise(0.0).alias("ke"))


def radii() -> np.ndarray:
    """Radii of the correlation dimension in deviations: 0.1 to 0.5 by factors of 1.03."""
    return 0.1 * 1.03 ** np.arange(int(math.log(5) / math.log(1.03)) + 1)


def correlation_dimension(s: DataFrame, key: str, m: int = 10) -> DataFrame:
    """(key, cd): slope of log C(r) on log r by least squares, C(r) the share of pairs of m-value vectors nearer than r,
    Euclidean, for radii() times the sample deviation; radii without pairs are left out, 0 where fewer than two are left."""
    e = _embedded(s, key, m)
    a, b = e.select(key, "i", F.col("v").alias("a")), e.select(key, F.col("i").alias("j"), F.col("v").alias("b"))
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    sd = s.groupBy(key).agg(F.stddev_samp("x").alias("sd"), F.count("*").alias("n"))
    far = float(radii()[-1])
    pairs = a.join(b, key).where("i < j").select(key, F.sqrt(square).alias("d")).join(sd, key).where(F.col("d") < far * F.col("sd"))
    r = F.array(*[F.lit(float(x)) for x in radii()])
    c = pairs.select(key, "n", "sd", "d", F.explode(r).alias("r")).where("d < r * sd").groupBy(key, "n", (F.col("r") * F.col("sd")).alias("r")).agg(F.count("*").alias("near"))
    share = F.col("near") * 2.0 / ((F.col("n") - m + 1) * (F.col("n") - m))
    slopes = c.withColumn("c", share).groupBy(key).agg(F.when(F.count("*") > 1, F.regr_slope(F.log("c"), F.log("r"))).alias("cd"))
    return sd.select(key).join(slopes, key, "left").select(key, F.coalesce(F.nanvl("cd", F.lit(0.0)), F.lit(0.0)).alias("cd"))


def _filtered(s: DataFrame, key: str, taps: list[float]) -> DataFrame:
    """One level of analysis: (key, o, x) for o = 0 ..., the convolution at odd places of the signal with its ends
    mirrored. The taps travel as a small table; a sample meets eight places at most."""
    f = len(taps)
    n = F.max("i").over(Window.partitionBy(key)) + 1
    sized = s.withColumn("n", n)
    # the sample's own place and its mirror images just outside either end
    at = F.array(F.col("i"), -1 - F.col("i"), 2 * F.col("n") - 1 - F.col("i"))
    spread = sized.withColumn("e", F.explode(at)).where(f"e >= -{f - 1} and e < n + {f - 1}")
    hit = spread.withColumn("t", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(h).alias("h")) for j, h in enumerate(taps)])))
    place = F.col("e") + F.col("t.j")
    return hit.where((place % 2 == 1) & (place >= 1) & (place < F.col("n") + f - 1)).groupBy(key, ((place - 1) / 2).cast("int").alias("o")).agg(F.sum(F.col("x") * F.col("t.h")).alias("x"))


def wavelet_details(s: DataFrame, key: str, levels: int) -> DataFrame:
    """(key, level, o, x): detail coefficients of a db4 decomposition, ends mirrored, as tap-table joins."""
    low = DB4
    high = [(-1) ** (j + 1) * h for j, h in enumerate(reversed(low))]
    out, now = None, s.select(key, "i", "x")
    for level in range(1, levels + 1):
        detail = _filtered(now, key, high).withColumn("level", F.lit(level))
        out = detail if out is None else out.unionByName(detail)
        now = _filtered(now, key, low).select(key, F.col("o").alias("i"), "x")
    return out.select(key, "level", "o", "x")


def _synthesised(c: DataFrame, key: str, taps: list[float], n: str) -> DataFrame:
    """One level of synthesis: (key, o, x) of coefficients (key, o, x) to the first `n` (a column) values of the level
    above, by the taps that a coefficient meets."""
    f = len(taps)
    hit = c.withColumn("t", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(h).alias("h")) for j, h in enumerate(taps)])))
    place = 2 * F.col("o") + F.col("t.j") - (f - 2)
    return hit.where((place >= 0) & (place < F.col(n))).groupBy(key, *[x for x in c.columns if x not in (key, "o", "x")], place.cast("int").alias("o")).agg(F.sum(F.col("x") * F.col("t.h")).alias("x"))


def wavelet_reconstructions(s: DataFrame, key: str, levels: int, approximation: bool = False) -> DataFrame:
    """(key, level, i, x): the signal itself as level 0, then for each level the signal that its details alone give
    back, of the same length; with approximation also what is left, as level -1. All but level 0 add up to it."""
    low = DB4
    high = [(-1) ** (j + 1) * h for j, h in enumerate(reversed(low))]
    sizes = s.groupBy(key).agg(F.count("*").cast("int").alias("n0"))
    for k in range(1, levels + 1):
        sizes = sizes.withColumn(f"n{k}", F.floor((F.col(f"n{k - 1}") + len(low) - 1) / 2).cast("int"))
    out, now = s.select(key, F.lit(0).alias("level"), "i", "x"), s.select(key, "i", "x")

    def back(c: DataFrame, k: int, first: list[float]) -> DataFrame:
        c = c.join(sizes, key)
        for j in range(k, 0, -1):
            c = _synthesised(c, key, list(reversed(first if j == k else low)), f"n{j - 1}")
        return c.select(key, F.col("o").alias("i"), "x")

    for k in range(1, levels + 1):
        out = out.unionByName(back(_filtered(now, key, high), k, high).select(key, F.lit(k).alias("level"), "i", "x"))
        rest = _filtered(now, key, low)
        now = rest.select(key, F.col("o").alias("i"), "x")
    if approximation:
        out = out.unionByName(back(rest, levels, low).select(key, F.lit(-1).alias("level"), "i", "x"))
    return out


def ten_features(s: DataFrame, key: str, n: int) -> DataFrame:
    """The ten features of windows of n samples in one row each: kur, ske, sm, sc, fd, cd, c0, pse, ke, se. Where a
    constant window leaves one without a value it is 0."""
    spec = spectrum(s, key, n)
    parts = [moments(s, key), hjorth(s, key), higuchi(s, key), correlation_dimension(s, key), c0_complexity(spec, key, n), spectral_entropy(spec, key, n), sample_entropy(s, key), amplitude_entropy(s, key)]
    return reduce(lambda a, b: a.join(b, key, "left"), parts).na.fill(0.0)


def moving_energy(s: DataFrame, key: str, width: int) -> DataFrame:
    """Adds energy, squared steps, and smooth: its centred moving average, zero beyond the ends. An even width reaches
    one sample further back than ahead."""
    order = Window.partitionBy(key).orderBy("i")
    step = F.col("x") - F.coalesce(F.lag("x").over(order), F.col("x"))
    return s.withColumn("energy", step * step).withColumn("smooth", F.sum("energy").over(order.rowsBetween(-(width // 2), (width - 1) // 2)) / width)


def peaks(s: DataFrame, key: str, column: str, height: Column, distance: int) -> DataFrame:
    """(key, i, x): local maxima of at least `height`, strictly above the value before and not below the one after, that
    no greater one (the later on a tie) within less than `distance` samples outdoes.

    Suppression is from the greatest down: a peak goes if a kept, greater one is near. It folds over the window's
    candidates in that order, an array bounded by the window's length."""
    order = Window.partitionBy(key).orderBy("i")
    c = s.withColumn("h", height).where(F.col(column).isNotNull()).withColumn("b", F.lag(column).over(order)).withColumn("a", F.lead(column).over(order))
    top = c.where((F.col(column) > F.col("b")) & (F.col(column) >= F.col("a")) & (F.col(column) >= F.col("h")))
    listed = top.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(column).alias("x"), F.col("i").cast("int").alias("i"))))).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<struct<x:double,i:int>>"), lambda acc, p: F.when(F.exists(acc, lambda q: F.abs(q["i"] - p["i"]) < distance), acc).otherwise(F.concat(acc, F.array(p))))
    return listed.select(key, F.explode(kept).alias("p")).select(key, F.col("p.i").alias("i"), F.col("p.x").alias("x"))


def r_peaks(s: DataFrame, key: str, fs: float) -> DataFrame:
    """(key, i) of heart beats: maxima of the smoothed slope energy, 0.3 s apart and at least 0.4 of its 90th percentile
    high, moved to the greatest distance from the median within 0.05 s. Windows under 0.5 s have none."""
    width, half = max(1, int(0.10 * fs)), int(0.05 * fs)
    long = s.groupBy(key).agg(F.count("*").alias("n"), F.median("x").alias("mid")).where(F.col("n") >= int(0.5 * fs))
    e = moving_energy(s.join(long.select(key), key, "left_semi"), key, width)
    least = e.groupBy(key).agg((F.percentile("smooth", F.lit(0.9)) * 0.4).alias("least"))
    found = peaks(e.join(least, key).select(key, "i", "smooth", "least"), key, "smooth", F.col("least"), int(0.30 * fs)).select(key, F.col("i").alias("p"))
    near = found.join(long, key).join(s, key).where((F.col("i") >= F.col("p") - half) & (F.col("i") < F.col("p") + half))
    return near.groupBy(key, "p").agg(F.max_by(-F.col("i"), F.struct(F.abs(F.col("x") - F.col("mid")).alias("d"), (-F.col("i")).alias("e"))).alias("m")).select(key, (-F.col("m")).cast("int").alias("i")).distinct()


def beats(s: DataFrame, found: DataFrame, key: str, fs: float) -> DataFrame:
    """One row per beat of found (key, i): rr, qrs_dur, qrs_amp, st_level, t_amp, t_sharp, qt; null where a part lies
    outside the window.

    Q and S are the least values within 60 ms before and after R; the ST level stands 80 ms after R and the T wave, the
    greatest distance from the median, 100 to 400 ms after it; QT ends where the wave first comes back below a quarter
    of T, or with the search."""
    order = Window.partitionBy(key).orderBy("i")
    side, st, t0, t1 = int(0.06 * fs), int(0.08 * fs), int(0.10 * fs), int(0.40 * fs)
    about = s.groupBy(key).agg(F.count("*").alias("n"), F.median("x").alias("mid"))
    r = found.withColumn("rr", (F.lead("i").over(order) - F.col("i")) / fs).withColumnRenamed("i", "r").join(about, key)
    near = r.join(s, key).where((F.col("i") >= F.col("r") - side) & (F.col("i") < F.col("r") + max(t1, st + 1, side)))
    d, at = F.abs(F.col("x") - F.col("mid")), F.col("i") - F.col("r")
    first = near.groupBy(key, "r", "rr", "n", "mid").agg(
        F.min(F.when(at < 0, F.struct("x", "i"))).alias("q"),
        F.min(F.when((at >= 0) & (at < side), F.struct("x", "i"))).alias("s"),
        F.max(F.when(at == 0, F.col("x"))).alias("top"),
        F.max(F.when(at == st, F.col("x"))).alias("st"),
        F.max(F.when((at >= t0) & (at < t1), F.struct(d.alias("d"), (-F.col("i")).alias("j"), F.col("x").alias("x")))).alias("t"),
        F.sort_array(F.collect_list(F.when((at >= t0) & (at < t1), F.struct("i", "x")))).alias("seg"),
    )  # the segment holds at most 0.3 s of samples
    whole = first.where((F.col("q").isNotNull()) & (F.least("n", F.col("r") + side) > F.col("r") + 1))
    has_t = F.size("seg") >= 3
    ti = -F.col("t.j")
    k = (ti - F.col("r") - t0 + 1).cast("int")
    bend = F.abs(F.try_element_at("seg", k - 1)["x"] - 2 * F.col("t.x") + F.try_element_at("seg", k + 1)["x"])
    level = 0.25 * F.when(F.col("t.d") == 0, 1.0).otherwise(F.col("t.d"))
    back = F.expr("filter(seg, y -> y.i >= -t.j)")
    ended = F.get(F.filter(back, lambda y: F.abs(y["x"] - F.col("mid")) < level), F.lit(0))["i"]
    end = F.coalesce(ended, F.element_at("seg", -1)["i"])
    return whole.select(
        key, "r", "rr", ((F.col("s.i") - F.col("q.i")) / fs).alias("qrs_dur"), (F.col("top") - F.least("q.x", "s.x")).alias("qrs_amp"), (F.col("st") - F.col("mid")).alias("st_level"),
        F.when(has_t, F.col("t.x") - F.col("mid")).alias("t_amp"),
        F.when(has_t & (k > 1) & (k < F.size("seg")), bend).alias("t_sharp"), F.when(has_t, (end - F.col("q.i")) / fs).alias("qt"),
    )


def beat_summary(rows: DataFrame, key: str) -> DataFrame:
    """Mean and population deviation of each beat measure, heart rate and the corrected QT by window."""
    names = ["rr", "qrs_dur", "qrs_amp", "qt", "st_level", "t_amp", "t_sharp"]
    out = rows.groupBy(key).agg(*[f(n).alias(f"{n}_{k}") for n in names for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    positive = F.when(F.col("rr_mean") > 0, F.col("rr_mean"))
    return out.withColumn("hr_mean", 60 / positive).withColumn("qtc", F.col("qt_mean") / F.sqrt(positive))


def heart_rate_variability(beats: DataFrame, key: str, fs: float) -> DataFrame:
    """(key, rr_mean, hr, sdnn, rmssd, pnn50) of beat places (key, i); the last three need two intervals.

    Sums are of whole samples, so they are exact; the rate comes in last."""
    order = Window.partitionBy(key).orderBy("i")
    rr = beats.withColumn("rr", (F.lead("i").over(order) - F.col("i")).cast("long")).where("rr is not null").withColumn("d", F.lead("rr").over(order) - F.col("rr"))
    g = rr.groupBy(key).agg(F.count("*").alias("n"), F.sum("rr").alias("t"), F.sum(F.col("rr") * F.col("rr")).alias("tt"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum((F.abs("d") > 0.050 * fs).cast("long")).alias("far"))
    n, t, many = F.col("n"), F.col("t"), F.col("n") >= 2
    sdnn = F.sqrt((n * F.col("tt") - t * t).cast("double")) / n / fs
    return g.select(key, (t / n / fs).alias("rr_mean"), (60 * fs * n / t).alias("hr"), F.when(many, sdnn).alias("sdnn"), F.when(many, F.sqrt(F.col("dd") / (n - 1)) / fs).alias("rmssd"), F.when(many, F.col("far") * 100.0 / (n - 1)).alias("pnn50"))


def pulse_shape(s: DataFrame, found: DataFrame, key: str, fs: float) -> DataFrame:
    """One row per pulse: key, peak, foot, next_foot, amp, rise, fall, ratio, area, width, augmentation.

    The foot is the least value between the peak before (or one second before) and the peak, the next foot likewise
    after it, the first on ties. Pulses with fewer than two samples on a side or without height are left out. width is
    the time between the first and last sample at half height or above; augmentation is the greatest second
    difference between peak and next foot over the height, if more than four samples lie there."""
    order = Window.partitionBy(key).orderBy("i")
    n = s.groupBy(key).agg((F.max("i") + 1).alias("n"))
    one = int(fs)
    spans = found.join(n, key).select(key, F.col("i").alias("peak"), F.coalesce(F.lag("i").over(order), F.greatest(F.col("i") - one, F.lit(0))).alias("lo"), F.coalesce(F.lead("i").over(order), F.least(F.col("n") - 1, F.col("i") + one)).alias("hi"))
    spans = spans.where("peak - lo >= 2 and hi - peak >= 2")
    near = spans.join(s, key).where("i >= lo and i < hi")
    before = F.when(F.col("i") < F.col("peak"), F.struct("x", "i"))
    after = F.when(F.col("i") >= F.col("peak"), F.struct("x", "i"))
    feet = near.groupBy(key, "peak").agg(F.min(before).alias("f"), F.min(after).alias("g"), F.max(F.when(F.col("i") == F.col("peak"), F.col("x"))).alias("top"))
    feet = feet.select(key, "peak", F.col("f.i").alias("foot"), F.col("f.x").alias("base"), F.col("g.i").alias("next_foot"), (F.col("top") - F.col("f.x")).alias("amp")).where("peak - foot >= 2 and next_foot - peak >= 2 and amp > 0")
    inner = feet.join(s, key).where("i >= foot and i < next_foot")
    along = Window.partitionBy(key, "peak").orderBy("i")
    inner = inner.withColumn("next", F.lead("x").over(along)).withColumn("third", F.lead("x", 2).over(along))
    high = F.col("x") >= F.col("base") + F.col("amp") / 2
    bend = F.when(F.col("i") >= F.col("peak"), F.col("third") - 2 * F.col("next") + F.col("x"))
    shape = inner.groupBy(key, "peak", "foot", "next_foot", "amp").agg(
        (F.sum((F.col("x") + F.col("next")) / 2 - F.col("base")) / fs).alias("area"),
        F.when(F.sum(high.cast("int")) >= 2, (F.max(F.when(high, F.col("i"))) - F.min(F.when(high, F.col("i")))) / fs).alias("width"),
        F.max(bend).alias("bend"),
    )
    rise, fall = (F.col("peak") - F.col("foot")) / fs, (F.col("next_foot") - F.col("peak")) / fs
    return shape.select(key, "peak", "foot", "next_foot", "amp", rise.alias("rise"), fall.alias("fall"), (rise / fall).alias("ratio"), "area", "width", F.when(F.col("next_foot") - F.col("peak") > 4, F.col("bend") / F.col("amp")).alias("augmentation"))


def side_by_side(frames: list[DataFrame], key: str) -> DataFrame:
    """Feature families of the same windows in one row each."""
    return reduce(lambda a, b: a.join(b, key), frames)
