"""Feature selection on training rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """The five named sets of a wide row's features, by the prefixes of its columns: temporal ones of each signal (ECG_,
    PPG_), morphological ones (ECGm_, PPGm_), both in that order, and those of one signal."""
    of = lambda *prefixes: [c for p in prefixes for c in columns if c.startswith(p)]
    temporal, morphological = of("ECG_", "PPG_"), of("ECGm_", "PPGm_")
    return {"temporal": temporal, "morphological": morphological, "fused": temporal + morphological, "ecg_only": of("ECG_", "ECGm_"), "ppg_only": of("PPG_", "PPGm_")}


def standardise(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean over their population deviation; a constant one becomes 0. One aggregate row joins all."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    scaled = [F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features]
    return rows.join(F.broadcast(stats)).select(*[c for c in rows.columns if c not in features], *scaled)


def f_scores(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, place, r, f): correlation with the target and F = r2 / (1 - r2) * (n - 2), all in one aggregate."""
    one = rows.agg(F.count(target).alias("n"), *[F.corr(c, target).alias(c) for c in features])
    listed = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("place"), F.col(c).alias("r")) for i, c in enumerate(features)])).alias("e")).select("n", "e.*")
    sq = F.col("r") * F.col("r")
    return listed.select("feature", "place", "r", (sq / F.nullif(1 - sq, F.lit(0.0)) * (F.col("n") - 2)).alias("f"))


def top_k(scores: DataFrame, by: str, k: int) -> DataFrame:
    """Adds rank and keeps the k best; equal scores go by column order."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "place"))).where(F.col("rank") <= k)


def intersection(sets: DataFrame, n_sets: int, features: list[str]) -> DataFrame:
    """(feature, place) of (set_name, feature) rows: features in all sets, in column order."""
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    return sets.groupBy("feature").agg(F.count_distinct("set_name").alias("n")).where(F.col("n") == n_sets).select("feature", place.cast("int").alias("place"))


def assembled(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows).select("features", F.col(target).alias("label"), "*")


def recursive_elimination(rows: DataFrame, features: list[str], target: str, k: int, step: float = 0.15, depth: int = 6) -> list[str]:
    """k features: a tree is fitted and the least important ones go, `step` of the first number at a time."""
    left, drop = list(features), max(1, int(len(features) * step))
    while len(left) > k:
        tree = DecisionTreeRegressor(maxDepth=depth, seed=42).fit(assembled(rows, left, target).select("features", "label"))
        worth = tree.featureImportances.toArray()
        order = sorted(range(len(left)), key=lambda i: (worth[i], -i))
        gone = set(order[: min(drop, len(left) - k)])
        left = [c for i, c in enumerate(left) if i not in gone]
    return left


def cross_sums(rows: DataFrame, columns: list[str], fold: str, about: list[float] | None = None) -> DataFrame:
    """(fold, i, j, total), i <= j: sums over each fold's rows of the products of columns i and j less `about`; column 0 is
    one, so (0, 0) counts rows and (0, j) sums column j. One scan; a task passes on a triangle for each fold. Rows with a
    null or NaN are left out."""
    p, shift = len(columns), np.array(about or [0.0] * len(columns))
    upper = np.triu_indices(p + 1)
    plain = rows.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def add(batches):
        total: dict[int | None, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            good = ~np.isnan(x).any(axis=1)
            z = np.column_stack([np.ones(len(x)), x - shift])
            folds = np.array(batch.column(0).to_pylist(), object)
            for f in set(folds):
                own = z[good & (folds == f)]
                total[f] = total.get(f, 0) + own.T @ own
        for f, t in total.items():
            n = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(t[upper])], ["fold", "i", "j", "total"])

    return plain.mapInArrow(add, "fold int, i int, j int, total double").groupBy("fold", "i", "j").agg(F.sum("total").alias("total"))


class Sums:
    """Counts, means and covariances of a set of rows, the target last, from cross_sums(); they add and subtract."""

    def __init__(self, total: np.ndarray):
        self.total, self.n = total, total[0, 0]

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.total + other.total)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.total - other.total)

    @property
    def mean(self) -> np.ndarray:
        return self.total[0, 1:] / max(self.n, 1)

    @property
    def covariance(self) -> np.ndarray:
        return self.total[1:, 1:] / max(self.n, 1) - np.outer(self.mean, self.mean)


def sums_by_fold(rows: DataFrame, features: list[str], target: str, fold: str = "fold") -> list[Sums]:
    """Sums of each fold, in order of the folds, about the first row's values, so that nothing cancels that needn't. The driver
    gets folds x p x p numbers."""
    columns = [*features, target]
    first = rows.select(*[F.col(c).cast("double") for c in columns]).na.drop().limit(1).collect()
    out: dict[int, np.ndarray] = {}
    for r in cross_sums(rows, columns, fold, list(first[0]) if first else None).collect():
        t = out.setdefault(r["fold"], np.zeros((len(columns) + 1, len(columns) + 1)))
        t[r["i"], r["j"]] = t[r["j"], r["i"]] = r["total"]
    return [Sums(out[f]) for f in sorted(out, key=lambda f: (f is not None, f))]


def path_of(sums: Sums, steps: int = 30, least: float = 1e-3) -> list[float]:
    """Penalties for standardised features, from the one at which all weights vanish down to `least` of it, in equal ratios."""
    cov = sums.covariance
    dev = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    top = float(np.max(np.abs(cov[:-1, -1]) / np.where(dev > 0, dev, np.inf), initial=0.0)) or 1.0
    return [top * least ** (i / (steps - 1)) for i in range(steps)]


def penalty_path(rows: DataFrame, features: list[str], target: str, steps: int = 30, least: float = 1e-3) -> list[float]:
    """path_of() the whole table."""
    got = sums_by_fold(rows.withColumn("fold", F.lit(0)), features, target)
    return path_of(got[0], steps, least) if got else [1.0] * steps


def descend(c: np.ndarray, xy: np.ndarray, penalty: float, start: np.ndarray, tolerance: float = 1e-10, sweeps: int = 10_000) -> np.ndarray:
    """Weights with the least w'cw / 2 - xy'w + penalty |w|, by coordinate descent from `start`."""
    w = start.copy()
    gradient = xy - c @ w
    for _ in range(sweeps):
        most = 0.0
        for i in np.flatnonzero(np.diag(c) > 1e-12):
            raw = gradient[i] + c[i, i] * w[i]
            step = np.sign(raw) * max(abs(raw) - penalty, 0.0) / c[i, i] - w[i]
            if step:
                w[i] += step
                gradient -= c[:, i] * step
                most = max(most, abs(step))
        if most <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def lasso_weights(folds: list[Sums], grid: list[float]) -> tuple[np.ndarray, float]:
    """(weights of standardised features, penalty): the penalty with the least squared error over the folds, refitted on all.

    Every fit is a descent on p x p sums; a fold's training sums are the whole less its own, and so is its error."""
    whole = sum(folds[1:], folds[0])
    mean, dev = whole.mean[:-1], np.sqrt(np.maximum(np.diag(whole.covariance)[:-1], 0))
    scale = np.where(dev > 1e-12 * np.maximum(1.0, np.abs(mean)), dev, np.inf)

    def standard(s: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        cov, m = s.covariance, s.mean
        return cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, (m[:-1] - mean) / scale, m[-1], cov[-1, -1]

    errors = np.zeros(len(grid))
    for own in folds:
        if own.n and whole.n > own.n:
            c, xy, at, y, _ = standard(whole - own)
            held_c, held_xy, held_at, held_y, held_var = standard(own)
            w = np.zeros(len(xy))
            for i, penalty in enumerate(grid):
                w = descend(c, xy, penalty, w)
                off = held_y - y - w @ (held_at - at)
                errors[i] += own.n * (off * off + held_var - 2 * w @ held_xy + w @ held_c @ w)
    best = grid[int(errors.argmin())]
    c, xy, *_ = standard(whole)
    return descend(c, xy, best, np.zeros(len(xy))), best


def lasso_rank(rows: DataFrame, features: list[str], target: str, grid: list[float] | None = None, fold: str = "fold") -> list[tuple[str, float]]:
    """(feature, |coefficient|), greatest first, from one pass over the rows; without a grid along path_of() them. Rows with a
    missing value are left out; without rows all weights are 0."""
    folds = sums_by_fold(rows, features, target, fold)
    weights = lasso_weights(folds, grid or path_of(sum(folds[1:], folds[0])))[0] if folds else np.zeros(len(features))
    return [(c, float(v)) for c, v in sorted(zip(features, np.abs(weights), strict=True), key=lambda x: -x[1])]


def select(rows: DataFrame, features: list[str], target: str, k: int = 60, least: int = 10, grid: tuple[float, ...] | None = None) -> dict:
    """Features chosen by F score, elimination and lasso alike, in column order: ufs, rfe, l1, selected, fallback, text.
    Without a grid lasso goes along path_of() the rows.

    With fewer than `least` in common the first ones by column order of the F-score set stand in, and fallback says so."""
    ufs_rows = top_k(f_scores(rows, features, target), "f", k).orderBy("place").collect()
    ufs = [r["feature"] for r in ufs_rows]
    rfe = recursive_elimination(rows, features, target, min(k, len(features)))
    ranked = lasso_rank(rows, features, target, list(grid) if grid else None)
    nonzero = sum(v > 1e-8 for _, v in ranked)
    l1 = [c for c, _ in ranked[: max(min(k, nonzero), least)]]
    both = [c for c in features if c in ufs and c in rfe and c in l1]
    fallback = len(both) < least
    chosen = ufs[:least] if fallback else both
    return {"ufs": ufs, "rfe": rfe, "l1": l1, "selected": chosen, "fallback": fallback, "text": f"UFS {len(ufs)}, RFE {len(rfe)}, L1 {len(l1)} -> intersection {len(chosen)}"}
