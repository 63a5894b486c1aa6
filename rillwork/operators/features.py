"""The wide feature row of paired signal windows: band-pass, wavelet reconstructions, ten features of each, beats and pulses
in one pass over Arrow batches of windows. beat_features and pulse_features are the same measures as joins over samples."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators import morphology, signals

# Names that readers of the feature table know, in their order.
TEN = ["Kur", "Ske", "SM", "SC", "FD", "CD", "C0", "PSE", "KE", "SE"]
BEAT = {"rr": "RR", "qrs_dur": "QRSdur", "qrs_amp": "QRSamp", "qt": "QT", "st_level": "STlevel", "t_amp": "Tamp", "t_sharp": "Tsharp"}
PULSE = {"amp": "Samp", "width": "Pwidth", "rise": "Rise", "fall": "Fall", "ratio": "RFratio", "area": "Parea", "augmentation": "AI"}
LEVELS, MOST = 7, 1024
#: Windows that one Arrow batch should hold: a pair of 16 s is some 40 KB.
BATCH = 200


@cache
def butterworth(order: int, low: float, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a Butterworth band-pass, by the bilinear transform of its poles."""
    edge = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, middle = edge[1] - edge[0], edge[0] * edge[1]
    half = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(half * half - middle)
    poles = np.concatenate((half + root, half - root))
    gain = np.real(width**order * (2 * fs) ** order / np.prod(2 * fs - poles))
    zeros = np.repeat([1.0, -1.0], order)
    return gain * np.poly(zeros), np.real(np.poly((2 * fs + poles) / (2 * fs - poles)))


def _filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows of x through a recursive filter, all rows at each step; state is what a row of ones would settle at."""
    z, out = state[:, None] * x[:, 0], np.empty_like(x)
    for t in range(x.shape[1]):
        v = x[:, t]
        y = out[:, t] = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1, None] * v - a[1:-1, None] * y
        z[-1] = b[-1] * v - a[-1] * y
    return out


def band_pass(x: np.ndarray, low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Rows of x without phase shift: forward, then backward, with the ends turned over to let the filter settle. Rows not
    longer than what is turned over give nan."""
    b, a = butterworth(order, low, high, fs)
    pad = 3 * len(a)
    if x.shape[1] <= pad:
        return np.full_like(x, np.nan)
    n = len(a) - 1
    step = np.eye(n) - np.eye(n, k=1)
    step[:, 0] += a[1:]
    state = np.linalg.solve(step, b[1:] - a[1:] * b[0])
    wide = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1)
    for _ in range(2):
        wide = _filtered(wide, b, a, state)[:, ::-1]
    return wide[:, pad:-pad]


def reconstructions(x: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """Rows of x, then what the details of each level of a db4 decomposition alone give back; ends are mirrored."""
    low = np.array(signals.DB4)
    high = low[::-1] * np.resize([-1.0, 1.0], len(low))
    f = len(low)

    def down(y: np.ndarray, taps: np.ndarray) -> np.ndarray:
        wide = np.pad(y, ((0, 0), (f - 1, f - 1)), mode="symmetric")
        return np.lib.stride_tricks.sliding_window_view(wide, f, axis=1)[:, 1::2] @ taps[::-1]

    def up(c: np.ndarray, taps: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(c), 2 * c.shape[1] + f))
        for j, tap in enumerate(taps[::-1]):
            out[:, j : j + 2 * c.shape[1] : 2] += tap * c
        return out[:, f - 2 : f - 2 + n]

    out, now, sizes = [x], x, []
    for _ in range(levels):
        sizes.append(now.shape[1])
        back = down(now, high)
        for k, n in enumerate(reversed(sizes)):
            back = up(back, high if k == 0 else low, n)
        out.append(back)
        now = down(now, low)
    return out


def _correlation_dimension(x: np.ndarray, m: int = 10) -> float:
    """As signals.correlation_dimension, of one row."""
    v = np.lib.stride_tricks.sliding_window_view(x - x.mean(), m)
    n, sd = len(v), x.std(ddof=1)
    if n < 2 or not sd > 0:
        return 0.0
    square = (v * v).sum(1)
    d = square[:, None] + square - 2 * (v @ v.T)
    np.fill_diagonal(d, np.inf)
    radii = sd * signals.radii()
    near = np.sort(np.sqrt(np.maximum(d[d < radii[-1] ** 2], 0)))
    c = np.searchsorted(near, radii) / (n * (n - 1))
    some = c > 0
    return float(np.polyfit(np.log(radii[some]), np.log(c[some]), 1)[0]) if some.sum() > 1 else 0.0


def _sample_entropy(x: np.ndarray) -> float:
    """As signals.sample_entropy, of one row."""
    near = np.abs(x[:, None] - x) <= 0.2 * x.std()
    n = len(x) - 2
    if n < 2:
        return 0.0
    two = near[:n, :n] & near[1 : n + 1, 1 : n + 1]
    b, a = two.sum() - n, (two & near[2:, 2:]).sum() - n
    return float(-np.log(a / b)) if a > 0 and b > 0 else 0.0


def ten_features(x: np.ndarray) -> np.ndarray:
    """The ten features of each row of x, in the order of TEN; nan where a constant row has none."""
    n = x.shape[1]
    with np.errstate(all="ignore"):
        d = x - x.mean(1, keepdims=True)
        var, dx, ddx = (d * d).mean(1), np.diff(x).var(1), np.diff(x, 2).var(1)
        mobility = np.sqrt(dx / var)
        lengths = []
        for k in range(1, 11):
            step = np.abs(x[:, k:] - x[:, :-k])
            place = np.arange(n - k) % k
            lengths.append(np.mean([step[:, place == m].mean(1) * (n - 1) / (k * k) for m in range(k) if (place == m).any()], axis=0) if n > k else np.full(len(x), np.nan))
        logs, at = np.log(np.where(np.array(lengths) > 0, lengths, np.nan)), -np.log(np.arange(1.0, 11))[:, None]
        used = np.isfinite(logs)
        count = used.sum(0)
        ma, ml = (np.where(used, v, 0).sum(0) / count for v in (at, logs))
        fd = np.where(used, (at - ma) * (logs - ml), 0).sum(0) / np.where(used, (at - ma) ** 2, 0).sum(0)
        times = np.where((np.arange(n // 2 + 1) == 0) | (2 * np.arange(n // 2 + 1) == n), 1, 2)
        power, flat = (np.abs(np.fft.rfft(v, axis=1)) ** 2 for v in (x, d))
        total = (power * times).sum(1)
        c0 = np.where(total > 0, (power * times * (power <= (total / n)[:, None])).sum(1) / total, 0.0)
        share = flat * times / (flat * times).sum(1, keepdims=True)
        pse = -np.where(share > 0, share * np.log2(share), 0).sum(1) / np.log2(n // 2 + 1) + 0 * share.sum(1)
        lo, span = x.min(1, keepdims=True), np.ptp(x, axis=1)[:, None]
        place = np.where(span > 0, np.minimum(np.floor((x - lo) / span * 64), 63), 32)
        place = np.where(np.isfinite(place), place, 0).astype(np.int64)
        p = np.bincount((place + 64 * np.arange(len(x))[:, None]).ravel(), minlength=64 * len(x)).reshape(len(x), 64) / n
        se = -np.where(p > 0, p * np.log2(p), 0).sum(1) + 0 * span[:, 0]
        every = x[:, :: -(-n // MOST)]
        cd, ke = ([f(r) if np.isfinite(r).all() else np.nan for r in every] for f in (_correlation_dimension, _sample_entropy))
        return np.column_stack([(d**4).mean(1) / var**2 - 3, (d**3).mean(1) / var**1.5, mobility, np.sqrt(ddx / dx) / mobility, fd, cd, c0, pse, ke, se])


def _rows(column: pa.Array) -> list:
    """The windows of a column; null and empty ones, and those with nulls, give None."""
    return [None if v is None or not len(v) or None in v else np.array(v, float) for v in column.to_pylist()]


def _by_length(rows: list, f) -> list:
    """f over the windows of equal length at once."""
    out: list = [None] * len(rows)
    for n in {len(r) for r in rows if r is not None}:
        some = [i for i, r in enumerate(rows) if r is not None and len(r) == n]
        for i, v in zip(some, f(np.stack([rows[i] for i in some])), strict=True):
            out[i] = v
    return out


def _passed(rows: list, band: tuple[float, float, float]) -> list:
    """Windows band-passed; those too short or without finite values become None."""
    return [None if v is None or np.isnan(v).any() else v for v in _by_length(rows, lambda x: list(band_pass(x, *band)))]


def _slices(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            yield whole.slice(at, BATCH)


def _temporal(rows: list, levels: int) -> np.ndarray:
    """Ten features of each window and of its wavelet levels; NaN where there is none."""
    none = np.full(10 * (levels + 1), np.nan)
    made = _by_length(rows, lambda x: np.concatenate([ten_features(r) for r in reconstructions(x, levels)], axis=1))
    return np.stack([none if v is None else v for v in made])


def ten_features_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, whether missing) of each of the ten features of a column of windows."""
    wide = _temporal(_rows(column), 0)
    return [(v, ~np.isfinite(v)) for v in wide.T]


def _temporal_names(prefix: str, levels: int) -> list[str]:
    return [f"{prefix}FE{k}_{t}" for k in range(levels + 1) for t in TEN]


def cleaned(windows: DataFrame, bands: dict[str, tuple[float, float, float]]) -> DataFrame:
    """windows with each signal column of bands (low, high, rate) band-passed; too short or null ones become null."""

    def run(batches):
        for batch in _slices(batches):
            for name, band in bands.items():
                column = batch.schema.get_field_index(name)
                batch = batch.set_column(column, name, pa.array(_passed(_rows(batch.column(column)), band), pa.list_(pa.float64())))
            yield batch

    return windows.mapInArrow(run, windows.schema)


def temporal_features(windows: DataFrame, key: str, names: dict[str, str], levels: int = LEVELS) -> DataFrame:
    """key and, for each signal column and its prefix in names, prefix + FE0_Kur ... FE7_SE: the ten features of the
    signal and of what each wavelet level alone gives back. A null, empty or constant signal leaves nulls."""
    columns = [c for p in names.values() for c in _temporal_names(p, levels)]

    def run(batches):
        for batch in _slices(batches):
            wide = np.concatenate([_temporal(_rows(batch.column(batch.schema.get_field_index(n))), levels) for n in names], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, mask=~np.isfinite(v)) for v in wide.T)], [key, *columns])

    kind = windows.schema[key].dataType.simpleString()
    return windows.select(key, *names).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{c}` double" for c in columns))


def _summary(rows: DataFrame, key: str, names: dict[str, str], prefix: str) -> DataFrame:
    return rows.groupBy(key).agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"{prefix}{n}_{k}") for c, n in names.items() for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def beat_features(windows: DataFrame, key: str, fs: float, prefix: str = "ECGm_") -> DataFrame:
    """key and nineteen measures of the beats of windows (key, x): means and deviations, rate, corrected QT, variability."""
    s = signals.samples(windows, key)
    found = signals.r_peaks(s, key, fs)
    out = _summary(signals.beats(s, found, key, fs), key, BEAT, prefix)
    every = signals.heart_rate_variability(found, key, fs)
    steady = F.when(F.col(f"{prefix}RR_mean") > 0, F.col(f"{prefix}RR_mean"))
    out = out.withColumn(f"{prefix}HR_mean", 60 / steady).withColumn(f"{prefix}QTc", F.col(f"{prefix}QT_mean") / F.sqrt(steady))
    return out.join(every.select(key, F.col("sdnn").alias(f"{prefix}SDNN"), F.col("rmssd").alias(f"{prefix}RMSSD"), F.col("pnn50").alias(f"{prefix}pNN50")), key, "left")


def pulse_features(windows: DataFrame, key: str, fs: float, prefix: str = "PPGm_") -> DataFrame:
    """key and fourteen measures of the pulses of windows (key, x); windows under a second have none."""
    s = signals.samples(windows.where(F.size("x") >= int(fs)), key)
    least = s.groupBy(key).agg((F.median("x") + 0.2 * F.stddev_pop("x")).alias("least"))
    found = signals.peaks(s.join(least, key), key, "x", F.col("least"), int(0.30 * fs))
    return _summary(signals.pulse_shape(s, found, key, fs), key, PULSE, prefix)


def window_rows(windows: DataFrame, key: str, ecg: tuple[float, float, float] = (0.5, 40.0, 250.0), ppg: tuple[float, float, float] = (0.5, 8.0, 64.0), levels: int = LEVELS) -> DataFrame:
    """The wide row of each window (key, ecg, ppg): both signals band-passed, ten features of each and of their wavelet
    levels, beats of the ecg, pulses of the ppg, and finite: whether all of them have a value.

    One pass over Arrow batches: each window is filtered once, nothing is exploded, joined or shuffled. Null, empty and short
    signals leave nulls and are not finite; rows that repeat give their row again; an empty table gives no rows. ecg and
    ppg give the band and the rate of each signal."""
    beat = [f"ECGm_{n}_{k}" for n in BEAT.values() for k in ("mean", "std")] + [f"ECGm_{n}" for n in ("HR_mean", "QTc", "SDNN", "RMSSD", "pNN50")]
    pulse = [f"PPGm_{n}_{k}" for n in PULSE.values() for k in ("mean", "std")]
    columns = [*_temporal_names("ECG_", levels), *_temporal_names("PPG_", levels), *beat, *pulse]

    def each(rows: list, f, width: int) -> np.ndarray:
        return np.stack([np.full(width, np.nan) if r is None else f(r) for r in rows])

    def run(batches):
        for batch in _slices(batches):
            heart, blood = _passed(_rows(batch.column(1)), ecg), _passed(_rows(batch.column(2)), ppg)
            parts = [_temporal(heart, levels), _temporal(blood, levels), each(heart, lambda x: morphology.beat_features(x, ecg[2]), len(beat)), each(blood, lambda x: morphology.pulse_features(x, ppg[2]), len(pulse))]
            wide = np.concatenate(parts, axis=1)
            finite = np.isfinite(wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, mask=~m) for v, m in zip(wide.T, finite.T, strict=True)), pa.array(finite.all(axis=1))], [key, *columns, "finite"])

    kind = windows.schema[key].dataType.simpleString()
    return windows.select(key, "ecg", "ppg").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{c}` double" for c in columns) + ", finite boolean")
