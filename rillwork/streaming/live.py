"""Streaming forms of smoothing, runs, grading and pairing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillwork.functions.grade import grades
from rillwork.operators.fusion import trailing_lambda


def run_sessions(readings: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(subject, t_start, t_end, n, mean): contiguous runs as session windows; one is given once it can't grow."""
    return readings.withWatermark("ts", late).groupBy("subject", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.avg("glucose").alias("mean")).select("subject", F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "n", "mean")


def rolling_grades(predictions: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Grades of each method over windows of event time (columns ts, method, glucose, pred)."""
    return predictions.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "method").agg(*grades()).select(F.col("w.start").alias("t_start"), "method", "r2", "rmse", "mard", "zone_a", "zone_ab")


def pair_signals(readings: DataFrame, windows: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Readings with the signal windows that end within `seconds` before them; a signal later than the watermark
    leaves its reading out."""
    r = readings.withWatermark("ts", late).alias("r")
    w = windows.withWatermark("t_end", late).alias("w")
    near = F.expr(f"r.subject = w.subject and w.t_end <= r.ts and w.t_end >= r.ts - interval {seconds} seconds")
    return r.join(w, near).select("r.subject", "r.ts", "r.glucose", "w.t_end", "w.x")


class _Smoother(StatefulProcessor):
    """Holds a subject's rows until the watermark has passed them, then takes them in order of time, and its run's last n
    values until no row can join the run any more."""

    def __init__(self, lam: list[float], n: int, g: float, max_gap_min: float):
        self.lam, self.n, self.g, self.gap = lam, n, g, int(max_gap_min * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trail = handle.getValueState("trail", "last long, trail array<double>")
        self.waiting = handle.getListState("waiting", "ms long, ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues):
        passed, new = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            new += [(int(ts.value // 1_000_000), ts.to_pydatetime(), float(v)) for ts, v in pdf[["ts", "value"]].dropna().itertuples(index=False)]
        new = [r for r in new if r[0] > passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new))
        yield pd.DataFrame(columns=["subject", "ts", "value", "smoothed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        last, trail = self.trail.get() if self.trail.exists() else (None, [])
        trail, out = list(trail or []), []
        for ms, ts, value in due:
            trail = [*([] if last is None or ms - last > self.gap else trail), value][-self.n :]
            last = ms
            out.append((key[0], ts, value, value if len(trail) == 1 else self._integral(trail)))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if last is not None and passed >= last + self.gap:  # what comes now begins a run of its own
            self.trail.clear()
        elif due:
            self.trail.update((last, trail))
            self.handle.registerTimer(last + self.gap)
        yield pd.DataFrame(out, columns=["subject", "ts", "value", "smoothed"])

    def _integral(self, trail: list[float]) -> float:
        total = measure = 0.0
        for v in sorted(trail, reverse=True):
            more = self.g + self.lam[len(trail) - 1] * measure * self.g
            measure, total = measure + more, total + v * more
        return total

    def close(self) -> None:
        pass


def smooth_stream(values: DataFrame, n: int = 7, g: float = 1 / 7, max_gap_min: float = 15, late: str = "1 hour") -> DataFrame:
    """(subject, ts, value, smoothed) of a stream (subject, ts, value) by the trailing Choquet integral of a run, as
    fusion.smooth gives it for a table.

    A row is given once the watermark, `late` behind the newest time, has passed it, so rows may come in any order within
    that; later ones and rows without time or value are left out. A subject leaves no state once its last row is more than
    the gap behind the watermark."""
    lam = trailing_lambda(values.sparkSession, n, g)
    return values.withWatermark("ts", late).groupBy("subject").transformWithStateInPandas(statefulProcessor=_Smoother(lam, n, g, max_gap_min), outputStructType="subject string, ts timestamp, value double, smoothed double", outputMode="Append", timeMode="EventTime")
