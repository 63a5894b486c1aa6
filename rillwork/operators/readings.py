"""Readings, contiguous runs, day boundaries and simple causal predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.zones import MGDL
from rillwork.operators.segments import scan


def clean_readings(raw: DataFrame, subject: str, ts: str, kind: str, value: str, kinds: list[str] | None = None) -> DataFrame:
    """(subject, ts, glucose): rows of the wanted kinds whose value is a number, from mg/dL to mmol/L."""
    rows = raw if kinds is None else raw.where(F.col(kind).isin(kinds))
    number = F.expr(f"try_cast({value} as double)")
    return rows.select(F.col(subject).cast("string").alias("subject"), F.col(ts).alias("ts"), (number / MGDL).alias("glucose")).na.drop()


def _longer(max_gap_min: float):
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return lambda before, own: micros(own) - micros(before) > max_gap_min * 60e6


def runs(readings: DataFrame, max_gap_min: float) -> DataFrame:
    """Adds run: a new one begins where the gap to the reading before is greater than max_gap_min."""
    return scan(readings, {"run": (_longer(max_gap_min), 0)})


def days(readings: DataFrame) -> DataFrame:
    """Adds ordinal (from 0), day_no and label: a new day where the date differs from the reading before."""
    out = scan(readings, {"day_no": (lambda before, own: F.to_date(own) != F.to_date(before), 1)}, ordinal="ordinal")
    return out.withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("label", F.concat(F.lit("day "), F.col("day_no").cast("string")))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in a stated order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def cap_per_group(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; k is the operator's limit."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


MODELS = ["LastReading", "TrailingMean", "PastMean"]


def causal_predictions(readings: DataFrame) -> DataFrame:
    """Predictions from a subject's own past: its last reading, the mean of up to seven, the mean of all so far."""
    past = scan(readings, tail=["glucose"], halo=7, sums=["glucose"])
    known = F.filter(F.transform("before", lambda x: x["glucose"]), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    out = past.withColumn("LastReading", F.get("before", F.size("before") - 1)["glucose"]).withColumn("TrailingMean", mean)
    return out.withColumn("PastMean", F.col("sum_glucose") / F.nullif("count_glucose", F.lit(0))).drop("before", "sum_glucose", "count_glucose").where("LastReading is not null")
