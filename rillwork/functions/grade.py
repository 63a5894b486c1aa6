"""Accuracy measures as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.zones import zone


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def mard(y: Column, p: Column) -> Column:
    """Mean absolute relative difference in percent; a reference of 0 is left out."""
    return F.avg(F.abs(p - y) / F.nullif(y, F.lit(0.0))) * 100


def r2(y: Column, p: Column) -> Column:
    """1 - squared error over the squares about the graded rows' own mean; null if these are all 0."""
    return 1 - F.sum((y - p) * (y - p)) / F.nullif(F.count(y) * F.var_pop(y), F.lit(0.0))


def zone_percent(y: Column, p: Column, letters: str) -> Column:
    """Percentage of rows in any of the letters' zones; rows without a zone aren't counted."""
    z = zone(y, p)
    return F.avg(F.when(z.isNull(), None).otherwise(z.isin(*letters).cast("double"))) * 100


def grades(y: str = "glucose", p: str = "pred") -> list[Column]:
    a, b = F.col(y), F.col(p)
    return [r2(a, b).alias("r2"), rmse(a, b).alias("rmse"), mard(a, b).alias("mard"), zone_percent(a, b, "A").alias("zone_a"), zone_percent(a, b, "AB").alias("zone_ab")]


def to_long(wide: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    """One row for each prediction: keep..., method, pred."""
    return wide.select(*keep, *methods).unpivot(keep, methods, "method", "pred")


def summarise(long: DataFrame, *by: str) -> DataFrame:
    """Grades pooled over the rows of each method (and of each value of `by`)."""
    return long.groupBy("method", *by).agg(*grades())


def per_fold(long: DataFrame) -> DataFrame:
    """Grades of each method and fold, and an `Average` row: the mean of the folds' grades, not the pooled ones."""
    folds = summarise(long, "fold").withColumn("fold", F.col("fold").cast("string"))
    mean = folds.groupBy("method").agg(F.lit("Average").alias("fold"), *[F.avg(c).alias(c) for c in ("r2", "rmse", "mard", "zone_a", "zone_ab")])
    return folds.unionByName(mean)


def fusion_audit(wide: DataFrame, fused: str, models: list[str]) -> DataFrame:
    """Whether the fusion has become the models' minimum: correlation with it, mean gap to it and to their mean."""
    low, mean = F.least(*models), sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    return wide.agg(F.corr(F.col(fused), low).alias("corr_min"), F.avg(F.abs(F.col(fused) - low)).alias("gap_min"), F.avg(F.abs(F.col(fused) - mean)).alias("gap_mean"))


def headline(summary: DataFrame, fused: str, control: str, singles: list[str]) -> DataFrame:
    """role, method, r2, rmse of a summary's fused method, its best single model (least rmse) and the control."""
    best = summary.where(F.col("method").isin(singles)).agg(F.min_by(F.struct("method", "r2", "rmse"), F.struct("rmse", "method")).alias("m")).select(F.lit("best single").alias("role"), "m.*")
    named = F.when(F.col("method") == fused, "fused").when(F.col("method") == control, "control")
    return summary.where(F.col("method").isin(fused, control)).select(named.alias("role"), "method", "r2", "rmse").unionByName(best)


def coverage(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: how many different keys are requested, how many of them are found, and whether all are."""
    both = requested.select(key).where(F.col(key).isNotNull()).distinct().join(found.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("requested"), F.count("hit").alias("covered")).withColumn("complete", F.col("requested") == F.col("covered"))


def finite_moments(value: Column) -> list[Column]:
    """n, mean and population deviation of the finite values; null where there are none."""
    some = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return [F.count(some).alias("n"), F.avg(some).alias("mean"), F.stddev_pop(some).alias("sd")]


def against_control(summary: DataFrame, control: str, margin: float = 0.02) -> DataFrame:
    """Each method beside the control: r2, control_r2 and whether it is better by the margin."""
    base = summary.where(F.col("method") == control).select(F.col("r2").alias("control_r2"))
    return summary.where(F.col("method") != control).join(F.broadcast(base)).select("method", "r2", "control_r2", F.when(F.col("r2") > F.col("control_r2") + margin, "better").otherwise("no better").alias("verdict"))
