"""From raw windows of two signals to scores: the rules that refuse a window, its features, the models' predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.operators.features import window_rows
from rillwork.operators.segments import last
from rillwork.plans.protocol import fit_and_score

FLAT = 1e-9


def _refused(name: str, n: int) -> Column:
    """Why a signal can't be used, or null: missing, too short, not finite or flat, judged on its last n samples."""
    x = last(F.col(name), n)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    reason = F.when(F.col(name).isNull(), "missing").when(F.size(name) < n, "too short").when(bad, "not finite").when(F.array_max(x) - F.array_min(x) < FLAT, "flat")
    return F.concat(F.lit(f"{name} "), reason)


def usable_windows(raw: DataFrame, n_ecg: int = 4000, n_ppg: int = 1024) -> DataFrame:
    """raw (ecg, ppg, ...) with both signals cut to their last samples, and reason: why the window is refused, or null. The ecg
    is judged first; refused windows keep their signals as they are."""
    judged = raw.withColumn("reason", F.coalesce(_refused("ecg", n_ecg), _refused("ppg", n_ppg)))
    cut_to = lambda name, n: F.when(F.col("reason").isNull(), last(F.col(name), n)).otherwise(F.col(name))
    return judged.withColumns({"ecg": cut_to("ecg", n_ecg), "ppg": cut_to("ppg", n_ppg)})


def wide_windows(raw: DataFrame, key: str, n_ecg: int = 4000, n_ppg: int = 1024, ecg: tuple[float, float, float] = (0.5, 40.0, 250.0), ppg: tuple[float, float, float] = (0.5, 8.0, 64.0)) -> DataFrame:
    """key, reason and the features of every window of raw (key, ecg, ppg); a refused one has a reason and no features."""
    judged = usable_windows(raw.select(key, "ecg", "ppg"), n_ecg, n_ppg)
    made = window_rows(judged.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("ecg", "ppg")}).drop("reason"), key, ecg, ppg).drop("finite")
    return judged.select(key, "reason").join(made, key)


def score_windows(wide: DataFrame, train: DataFrame, features: list[str], target: str, learners: dict | None = None) -> DataFrame:
    """wide_windows() with every method's prediction, by models of train (subject, ts, target, features), and reason: why a
    window was refused, which features it lacks, or null. Every window is in the result, with its other columns."""
    good, refused = wide.where("reason is null").drop("reason"), wide.where("reason is not null")
    return fit_and_score(train, good, features, target, learners).unionByName(refused, allowMissingColumns=True)
