"""Windows along each subject's time in two steps, so that a subject of any length spreads over tasks.

Rows are ordered inside (subject, bin of time). A bin passes on a summary of a fixed size; summaries, a row a bin, are
ordered by subject and tell each bin what came before it. No task holds more rows than a bin has, or than a subject has
bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bin: 30 days, some 8,640 readings at one every five minutes.
BIN = 30 * 86_400


def last(items: Column, n: int) -> Column:
    """The last n of an array, or all of it."""
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, n)


def scan(rows: DataFrame, marks: dict[str, tuple[Callable[[Column, Column], Column], int]] | None = None, tail: list[str] | None = None, halo: int = 0, sums: list[str] | None = None, ordinal: str | None = None, seconds: int = BIN) -> DataFrame:
    """rows (subject, ts, ...) with columns that depend on a subject's earlier rows, in order of ts.

    marks: name to (condition of the ts before and the own ts, value for a subject's first row); the column counts the
    conditions that held up to the row. tail and halo: `before`, an array of structs of the tail columns of up to halo
    earlier rows, the nearest last. sums: sum_<c> and count_<c> of a column over all earlier rows. ordinal: the name of a
    column that counts the earlier rows. A null ts comes first; rows of one ts follow each other in no order."""
    marks, tail, sums = marks or {}, tail or [], sums or []
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    binned = rows.withColumn("_bin", F.coalesce(F.floor(micros / (seconds * 1_000_000)), F.lit(-(1 << 62))).cast("long"))
    inside = Window.partitionBy("subject", "_bin").orderBy("ts")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    one = F.struct(*tail) if tail else None
    held = {f"_m_{m}": F.when(F.row_number().over(inside) == 1, 0).otherwise(F.coalesce(test(F.lag("ts").over(inside), F.col("ts")).cast("int"), F.lit(0))) for m, (test, _) in marks.items()}
    own = binned.withColumns({"_i": F.row_number().over(inside), **held})
    own = own.withColumns({f"_c_{m}": F.sum(f"_m_{m}").over(inside) for m in marks} | {f"_s_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in sums} | {f"_n_{c}": F.count(c).over(earlier) for c in sums})
    own = own.withColumn("_trail", F.collect_list(one).over(inside.rowsBetween(-halo, -1))) if tail else own
    of_bin = [F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.sum(f"_m_{m}").alias(f"m_{m}") for m in marks]]
    of_bin += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{c}") for c in sums] + [F.count(c).alias(f"n_{c}") for c in sums]
    of_bin += [F.max_by(last(F.concat("_trail", F.array(one)), halo), "_i").alias("tail")] if tail else []
    bins = own.groupBy("subject", "_bin").agg(*of_bin)
    along = Window.partitionBy("subject").orderBy("_bin")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    for m, (test, first) in marks.items():
        prior = F.lag("last_ts").over(along)
        at_first = F.when(F.row_number().over(along) == 1, first).otherwise(F.coalesce(test(prior, F.col("first_ts")).cast("int"), F.lit(0)))
        bins = bins.withColumn(f"f_{m}", at_first)
        bins = bins.withColumn(f"o_{m}", F.sum(F.col(f"m_{m}") + F.col(f"f_{m}")).over(along) - F.col(f"m_{m}"))
    bins = bins.withColumn("o_n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bins = bins.withColumns({f"o_{k}_{c}": F.coalesce(F.sum(f"{k}_{c}").over(before), F.lit(0)) for c in sums for k in ("s", "n")})
    bins = bins.withColumn("o_tail", last(F.flatten(F.collect_list("tail").over(along.rowsBetween(-halo, -1))), halo)) if tail else bins
    bins = bins.select("subject", F.col("_bin").alias("_b"), *[c for c in bins.columns if c.startswith("o_")]).withColumnRenamed("subject", "_subject")
    joined = own.join(bins, F.col("subject").eqNullSafe(F.col("_subject")) & (F.col("_bin") == F.col("_b")))
    out = joined.withColumns({m: F.col(f"_c_{m}") + F.col(f"o_{m}") for m in marks} | {f"sum_{c}": F.col(f"_s_{c}") + F.col(f"o_s_{c}") for c in sums} | {f"count_{c}": F.col(f"_n_{c}") + F.col(f"o_n_{c}") for c in sums})
    out = out.withColumn("before", last(F.concat("o_tail", "_trail"), halo)) if tail else out
    out = out.withColumn(ordinal, F.col("_i") - 1 + F.col("o_n")) if ordinal else out
    made = [*marks, *(["before"] if tail else []), *[f"{k}_{c}" for c in sums for k in ("sum", "count")], *([ordinal] if ordinal else [])]
    return out.select(*[c for c in rows.columns if c not in made], *made)
