"""Splits that never move a row: a fold column, computed from the row or from its group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.operators.lineage import cut


def micros() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def hash_fold(rows: DataFrame, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Random folds 0 to k - 1 from a digest of (subject, ts, seed); sizes are nearly equal, order plays no part."""
    digest = F.md5(F.concat_ws(":", F.col("subject"), micros().cast("string"), F.lit(str(seed))))
    return rows.withColumn(name, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int"))


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject").agg(F.count("*").alias("n"))


def deal_sizes(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(n, begin, end, cycle): of the subjects with n rows, in order, those numbered begin to end - 1 go round cycle.

    sizes: (n, subjects with n rows), greatest n first. Each subject goes to the lightest of folds 1 to k so far, the first
    of equals. A fold of load L gets subjects of n rows at loads L, L + n, L + 2n and so on, so it joins the rounds at
    level L div n, and in a round folds stand in order of L mod n: at most k cycles per size, however many subjects."""
    load, out = [0] * k, []
    for n, subjects in sizes:
        levels = sorted({x // n for x in load})
        begin, got = 0, [0] * k
        for level, above in zip(levels, [*levels[1:], None], strict=True):
            cycle = sorted((f for f in range(k) if load[f] // n <= level), key=lambda f: (load[f] % n, f))
            left = subjects - begin
            take = left if above is None else min(left, len(cycle) * (above - level))
            if take:
                out.append((n, begin, begin + take, [f + 1 for f in cycle]))
                for i, f in enumerate(cycle):
                    got[f] += (take - i + len(cycle) - 1) // len(cycle)
            begin += take
        load = [x + n * g for x, g in zip(load, got, strict=True)]
    return out


def group_fold(rows: DataFrame, k: int) -> DataFrame:
    """Adds fold 1 to k so that no subject is in two: subjects by size, each to the lightest fold so far.

    One rule at every size: the driver deals the distinct sizes (fewer than the root of twice the rows), not subjects.
    Subjects are numbered within their size by a sort in ranges and joined to rows by shuffle."""
    sized = cut(group_sizes(rows).repartitionByRange(F.desc("n"), F.asc_nulls_first("subject")).sortWithinPartitions(F.desc("n"), F.asc_nulls_first("subject")).select("subject", "n", F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], -r["n"], r["first"], r["c"]) for r in sized.groupBy(part.alias("part"), "n").agg(F.min(place).alias("first"), F.count("*").alias("c")).toLocalIterator())
    seen: dict[int, int] = {}
    begins = []
    for p, m, first, c in counts:
        begins.append((p, -m, seen.get(m, 0) - first))
        seen[m] = seen.get(m, 0) + c
    dealt = deal_sizes([(-m, c) for m, c in sorted(seen.items())], k)
    spark = rows.sparkSession
    shift = F.broadcast(spark.createDataFrame(begins, "part long, n long, shift long"))
    rounds = F.broadcast(spark.createDataFrame(dealt, "n long, begin long, end long, cycle array<int>"))
    numbered = sized.withColumn("part", part).join(shift, ["part", "n"]).withColumn("number", place + F.col("shift"))
    of_size = numbered.join(rounds, "n").where("number >= begin and number < end")
    return rows.join(of_size.select("subject", F.expr("get(cycle, cast(pmod(number - begin, size(cycle)) as int))").alias("fold")).hint("shuffle_merge"), "subject")


def loso_fold(rows: DataFrame) -> DataFrame:
    """Adds fold: one for each subject, 1 for the largest; equal sizes go by subject."""
    ranked = group_sizes(rows).withColumn("fold", F.row_number().over(Window.orderBy(F.desc("n"), "subject"))).select("subject", "fold")
    return rows.join(ranked, "subject")


def splits(rows: DataFrame, protocol: str, k: int = 5) -> DataFrame:
    """The fold column of a named protocol; an unknown name is an error."""
    made = {"random_window": lambda: hash_fold(rows, k), "subject_aware": lambda: group_fold(rows, k), "loso": lambda: loso_fold(rows)}
    if protocol not in made:
        raise ValueError(f"unknown protocol {protocol!r}; one of {sorted(made)}")
    return made[protocol]()


def no_skill(rows: DataFrame, target: str = "glucose") -> DataFrame:
    """(fold, NoSkillBaseline, n_train, n_test): the target's mean over all other folds, in one pass over the rows."""
    each = rows.groupBy("fold").agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    whole = Window.partitionBy()
    s, n = F.sum("s").over(whole), F.sum("n").over(whole)
    return each.select("fold", ((s - F.col("s")) / F.nullif(n - F.col("n"), F.lit(0))).alias("NoSkillBaseline"), (n - F.col("n")).alias("n_train"), F.col("n").alias("n_test"))
