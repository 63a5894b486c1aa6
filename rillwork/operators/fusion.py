"""Fusing several models' predictions, across models and along time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.fuzzy import choquet, density, pairs, sugeno_lambda, sugeno_lambda3
from rillwork.operators.readings import runs
from rillwork.operators.segments import scan


def fold_densities(rows: DataFrame, models: list[str], target: str = "glucose") -> DataFrame:
    """(fold, g_<model>..., lambda) of three models: each one's R2 over the rows of all other folds, and the measure's
    lambda. Sums by fold are taken once; a fold's training sums are the totals less its own."""
    sums = [F.count(target).alias("n"), F.sum(target).alias("y"), F.sum(F.col(target) * F.col(target)).alias("yy")]
    sums += [F.sum(F.pow(F.col(target) - F.col(m), 2)).alias(f"e_{m}") for m in models]
    each = rows.groupBy("fold").agg(*sums)
    names = ["n", "y", "yy", *[f"e_{m}" for m in models]]
    rest = each.select("fold", *[(F.sum(c).over(Window.partitionBy()) - F.col(c)).alias(c) for c in names])
    about_mean = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    out = rest.select("fold", *[density(1 - F.col(f"e_{m}") / about_mean).alias(f"g_{m}") for m in models])
    return out.withColumn("lambda", sugeno_lambda3(*[F.col(f"g_{m}") for m in models]))


def fuse(rows: DataFrame, densities: DataFrame, models: list[str]) -> DataFrame:
    """Adds PlainAverage, WeightedAverage, Choquet and MinOfModels to rows with a fold column."""
    joined = rows.join(F.broadcast(densities), "fold")
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    g = [F.col(f"g_{m}") for m in models]
    return (
        joined.withColumn("PlainAverage", add([F.col(m) for m in models]) / len(models))
        .withColumn("WeightedAverage", add([F.col(m) * w for m, w in zip(models, g, strict=True)]) / add(g))
        .withColumn("Choquet", choquet(pairs(models, [f"g_{m}" for m in models]), F.col("lambda")))
        .withColumn("MinOfModels", F.least(*models))
    )


def trailing_lambda(spark, n: int, g: float) -> list[float]:
    """Lambda of 1 to n equal densities; one density alone has none and 0 stands for it."""
    made = spark.range(1, n + 1).select("id", F.when(F.col("id") == 1, 0.0).otherwise(sugeno_lambda(F.array_repeat(F.lit(float(g)), F.col("id").cast("int")))).alias("lam"))
    return [r["lam"] for r in made.orderBy("id").collect()]


def smoothings(rows: DataFrame, values: list[str], wanted: dict[str, tuple[str, float]], n: int = 7, max_gap_min: float = 15) -> DataFrame:
    """Adds columns, name to (value, density): the Choquet integral, all densities equal, of a value and up to n - 1 before
    it in its contiguous run. All of them read one trail of `values`, gathered once.

    A run ends at a gap of more than max_gap_min; its first value stands for itself, and nulls are no values."""
    named = rows if "run" in rows.columns else runs(rows, max_gap_min)
    trail = scan(named, tail=["run", *values], halo=n - 1)
    same = F.filter("before", lambda x: x["run"].eqNullSafe(F.col("run")))

    def past(value: str) -> F.Column:
        return F.filter(F.concat(F.transform(same, lambda x: x[value]), F.array(value)), lambda x: x.isNotNull())

    trail = trail.withColumns({f"_t_{v}": past(v) for v in values})
    lams = {g: F.array(*map(F.lit, trailing_lambda(rows.sparkSession, n, g))) for _, g in wanted.values()}

    def fused(value: str, g: float) -> F.Column:
        held = F.col(f"_t_{value}")
        whole = choquet(F.transform(held, lambda v: F.struct(v.alias("value"), F.lit(float(g)).alias("density"))), F.get(lams[g], F.size(held) - 1))
        return F.when(F.size(held) <= 1, F.get(held, F.lit(0))).otherwise(whole)

    return trail.withColumns({name: fused(v, g) for name, (v, g) in wanted.items()}).drop("before", *[f"_t_{v}" for v in values])


def smooth(rows: DataFrame, value: str, out: str, n: int = 7, g: float = 1 / 7, max_gap_min: float = 15) -> DataFrame:
    """One smoothing of smoothings()."""
    return smoothings(rows, [value], {out: (value, g)}, n, max_gap_min)


def reliability_weighted(long: DataFrame) -> DataFrame:
    """(subject, ts, glucose, pred): a mean over methods weighted by one over each one's mean squared error."""
    worth = long.groupBy("method").agg((1 / F.avg(F.pow(F.col("pred") - F.col("glucose"), 2))).alias("r"))
    return long.join(F.broadcast(worth), "method").groupBy("subject", "ts", "glucose").agg((F.sum(F.col("pred") * F.col("r")) / F.sum("r")).alias("pred"))


