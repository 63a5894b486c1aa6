"""Windows along time by bins equal those over whole subjects, with one subject that holds half of all rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillwork import queries
from rillwork.operators import fusion, readings, segments


def made(spark):
    r = random.Random(3)
    rows = []
    for subject, n in [("busy", 600), *[(f"s{i}", r.randint(1, 40)) for i in range(25)]]:
        at = 0
        for _ in range(n):
            at += r.choice((5, 5, 5, 5, 16, 300, 5000, 60_000))
            rows.append((subject, at * 60 + 1_000_000, float(r.randint(3, 20))))
    rows += [(None, 5_000_000, 4.0), (None, 5_000_300, 6.0)]
    return rows, spark.createDataFrame(rows, "subject string, s long, glucose double").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_scans_equal_windows_over_whole_subjects(spark):
    rows, df = made(spark)
    of = Window.partitionBy("subject").orderBy("ts")
    micros = F.unix_micros("ts")
    new = F.coalesce(((micros - F.lag(micros).over(of)) / 60e6 > 15).cast("int"), F.lit(0))
    want = df.withColumn("new", new).withColumn("run", F.sum("new").over(of)).drop("new")
    got = readings.runs(df, 15)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    past = of.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("subject", "ts", F.lag("glucose").over(of).alias("LastReading"), F.round(F.avg("glucose").over(of.rowsBetween(-7, -1)), 6).alias("t"), F.round(F.avg("glucose").over(past), 6).alias("p")).where("LastReading is not null")
    ours = readings.causal_predictions(df).select("subject", "ts", "LastReading", F.round("TrailingMean", 6).alias("t"), F.round("PastMean", 6).alias("p"))
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, plain.collect()))
    for seconds in (3600, 10_000_000_000):
        trail = segments.scan(df, tail=["glucose"], halo=4, ordinal="k", seconds=seconds)
        want = df.select("subject", "ts", F.collect_list(F.struct("glucose")).over(of.rowsBetween(-4, -1)).alias("before"), (F.row_number().over(of) - 1).cast("long").alias("k"))
        assert sorted(map(repr, trail.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_no_window_orders_a_whole_subject(spark):
    rows, df = made(spark)
    bins = df.groupBy("subject", F.floor(F.unix_seconds("ts") / segments.BIN)).count().agg(F.max("count")).first()[0]
    assert bins < 600 / 5
    for out in (readings.runs(df, 15), readings.days(df), readings.causal_predictions(df), fusion.smooth(df, "glucose", "s")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("_bin" in line for line in plan.splitlines() if " Window [" in line)


def test_smoothings_share_a_trail(spark):
    _, df = made(spark)
    both = fusion.smoothings(df.withColumn("twice", 2 * F.col("glucose")), ["glucose", "twice"], {"a": ("glucose", 1 / 7), "b": ("twice", 1 / 7), "c": ("glucose", 0.3)})
    got = both.agg(F.max(F.abs(F.col("b") - 2 * F.col("a"))), F.count("c"), F.count("*")).first()
    assert got[0] < 1e-9 and got[1] == got[2] == df.count()
    assert fusion.smooth(df.limit(0), "glucose", "s").count() == 0


def copied(spark, folder, copies):
    """Users 162 and 204, whose mean of some first readings is exactly 50 mg/dL, a corner of zone A, and copies of them."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id in (162, 204)")
    shifted = events.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("user_id", F.col("user_id") + 1500 * F.col("i")).drop("i")
    shifted.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_copies_of_a_subject_are_graded_alike(spark, tmp_path):
    got = queries.QUERIES["grade_by_subject"](spark, copied(spark, tmp_path, 6)).where("method = 'PastMean'").collect()
    by = {u: {r["zone_a"] for r in got if int(r["subject"]) % 1500 == u} for u in (162, 204)}
    assert len(got) == 12 and len(by[162]) == 1 and by[204] == {43.835616}


def test_copies_of_a_subject_fall_in_the_same_zones(spark, tmp_path):
    counts = []
    for n in (1, 6):
        (tmp_path / str(n)).mkdir()
        got = queries.QUERIES["zone_distribution"](spark, copied(spark, tmp_path / str(n), n)).where("method = 'PastMean'").first()
        counts.append([got[z] for z in "ABCDE"])
    assert counts[1] == [6 * c for c in counts[0]] and sum(counts[0]) > 100
