"""Beats and pulses of one signal window as numpy steps, for passes over Arrow batches of windows. The definitions are those of
`signals`, which has them as joins over samples; tests hold the two against each other."""

from __future__ import annotations

import numpy as np

NAN = float("nan")


def moving_energy(x: np.ndarray, width: int) -> np.ndarray:
    """Squared steps, averaged over `width` samples, zero beyond the ends."""
    total = np.concatenate(([0.0], np.cumsum(np.diff(x, prepend=x[:1]) ** 2)))
    at = np.arange(len(x))
    return (total[np.minimum(at + (width - 1) // 2 + 1, len(x))] - total[np.maximum(at - width // 2, 0)]) / width


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Places of local maxima of at least `height`, the greatest (the later on a tie) first, none nearer than `distance` to
    one already taken; in order."""
    inner = x[1:-1]
    at = np.flatnonzero((inner > x[:-2]) & (inner >= x[2:]) & (inner >= height)) + 1
    free, taken = np.ones(len(x) + 2 * distance, bool), []
    for i in at[np.lexsort((at, x[at]))[::-1]]:
        if free[i + distance]:
            taken.append(i)
            free[i + 1 : i + 2 * distance] = False
    return np.sort(np.array(taken, np.int64))


def least(x: np.ndarray, lo: int, hi: int) -> int:
    """The place of the least of x[lo:hi], the first on a tie."""
    return lo + int(x[lo:hi].argmin())


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Places of heart beats; see signals.r_peaks."""
    n, half = len(x), int(0.05 * fs)
    if n < int(0.5 * fs) or n < 3:
        return np.zeros(0, np.int64)
    smooth = moving_energy(x, max(1, int(0.10 * fs)))
    away = np.abs(x - np.median(x))
    found = peaks(smooth, 0.4 * np.percentile(smooth, 90), int(0.30 * fs))
    spans = ((max(p - half, 0), min(p + half, n)) for p in found)
    return np.unique(np.array([lo + int(away[lo:hi].argmax()) for lo, hi in spans if hi > lo], np.int64))


def beats(x: np.ndarray, found: np.ndarray, fs: float) -> np.ndarray:
    """A row for each whole beat: rr, qrs_dur, qrs_amp, qt, st_level, t_amp, t_sharp; see signals.beats."""
    side, st, t0, t1 = int(0.06 * fs), int(0.08 * fs), int(0.10 * fs), int(0.40 * fs)
    n, mid, out = len(x), np.median(x), []
    away = np.abs(x - mid)
    for k, r in enumerate(found):
        following = found[k + 1] if k + 1 < len(found) else None
        if r == 0 or side < 1 or min(n, r + side) <= r + 1:
            continue
        q, s = least(x, max(r - side, 0), r), least(x, r, min(r + side, n))
        row = [NAN if following is None else (following - r) / fs, (s - q) / fs, x[r] - min(x[q], x[s]), NAN, x[r + st] - mid if r + st < n else NAN, NAN, NAN]
        lo, hi = r + t0, min(r + t1, n)
        if hi - lo >= 3:
            t = lo + int(away[lo:hi].argmax())
            row[5] = x[t] - mid
            if lo < t < hi - 1:
                row[6] = abs(x[t - 1] - 2 * x[t] + x[t + 1])
            back = np.flatnonzero(away[t:hi] < 0.25 * (away[t] or 1.0))
            row[3] = ((t + back[0] if len(back) else hi - 1) - q) / fs
        out.append(row)
    return np.array(out, float).reshape(-1, 7)


def pulses(x: np.ndarray, fs: float) -> np.ndarray:
    """A row for each pulse: amp, width, rise, fall, ratio, area, augmentation; see signals.pulse_shape."""
    n, one, out = len(x), int(fs), []
    if n < max(one, 3):
        return np.zeros((0, 7))
    found = peaks(x, np.median(x) + 0.2 * x.std(), int(0.30 * fs))
    for k, p in enumerate(found):
        lo = found[k - 1] if k else max(p - one, 0)
        hi = found[k + 1] if k + 1 < len(found) else min(n - 1, p + one)
        if p - lo < 2 or hi - p < 2:
            continue
        foot, after = least(x, lo, p), least(x, p, hi)
        amp = x[p] - x[foot]
        if p - foot < 2 or after - p < 2 or amp <= 0:
            continue
        inner = x[foot:after]
        high = np.flatnonzero(inner >= x[foot] + amp / 2)
        tail = x[p:after]
        rise, fall = (p - foot) / fs, (after - p) / fs
        bend = (tail[2:] - 2 * tail[1:-1] + tail[:-2]).max() / amp if after - p > 4 else NAN
        out.append([amp, (high[-1] - high[0]) / fs if len(high) >= 2 else NAN, rise, fall, rise / fall, ((inner[1:] + inner[:-1]) / 2 - x[foot]).sum() / fs, bend])
    return np.array(out, float).reshape(-1, 7)


def summary(rows: np.ndarray) -> np.ndarray:
    """Mean and population deviation of each column in turn, over its finite values."""
    out = np.full(2 * rows.shape[1], NAN)
    for j, column in enumerate(rows.T):
        good = column[~np.isnan(column)]
        if len(good):
            out[2 * j : 2 * j + 2] = good.mean(), good.std()
    return out


def beat_features(x: np.ndarray, fs: float) -> np.ndarray:
    """Summaries of the seven beat measures, heart rate, corrected QT, and SDNN, RMSSD and pNN50 of all intervals."""
    found = r_peaks(x, fs)
    about = summary(beats(x, found, fs))
    rate = [60 / about[0], about[6] / np.sqrt(about[0])] if about[0] > 0 else [NAN, NAN]
    rr = np.diff(found)
    steps = np.diff(rr)
    vary = [rr.std() / fs, np.sqrt((steps**2).mean()) / fs, 100.0 * (np.abs(steps) > 0.050 * fs).mean()] if len(rr) >= 2 else [NAN] * 3
    return np.concatenate([about, rate, vary])


def pulse_features(x: np.ndarray, fs: float) -> np.ndarray:
    """Summaries of the seven pulse measures."""
    return summary(pulses(x, fs))
