import time

import pytest
from pyspark.sql import functions as F

from rillwork.operators import fusion
from rillwork.streaming import live


def _stream(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


ROWS = [("a", f"2024-01-01 00:{5 * i:02d}:00", v) for i, v in enumerate((7.0, 7.2, 7.1, 11.0, 7.3))] + [("a", "2024-01-01 00:45:00", 5.0), ("z", "2024-01-09 00:00:00", 1.0)]


def test_runs_close_behind_the_watermark(spark, tmp_path):
    s = _stream(spark, tmp_path, ROWS, "subject string, ts string, glucose double", "r")
    got = sorted((r["subject"], r["n"]) for r in _run(live.run_sessions(s), "sessions"))
    assert got == [("a", 1), ("a", 5)]


def test_grades_by_day(spark, tmp_path):
    rows = [(t, "m", g, g + 1) for _, t, g in ROWS]
    s = _stream(spark, tmp_path, rows, "ts string, method string, glucose double, pred double", "g")
    got = _run(live.rolling_grades(s), "grades")
    assert len(got) == 1 and got[0]["rmse"] == pytest.approx(1.0)


def _batches(spark, tmp_path, batches, checkpoint):
    """Smooths files that come one after the other; the last ones only move the watermark."""
    schema = "subject string, ts timestamp, value double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "subject string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.smooth_stream(s, late="10 minutes").writeStream.format("memory").queryName("smoothed").option("checkpointLocation", checkpoint).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return sorted(((r["subject"], str(r["ts"]), r["value"], round(r["smoothed"], 9)) for r in spark.table("smoothed").collect()), key=lambda r: r[:2])


def test_smoothing_by_event_time(spark, tmp_path):
    """Rows late within the watermark give the batch form's result, later ones are left out, idle subjects leave no state."""
    day = "2024-01-01"
    one = [("a", f"{day} 00:00:00", 7.0), ("a", f"{day} 00:10:00", 7.1), ("b", f"{day} 00:05:00", 3.0)]
    two = [("a", f"{day} 00:05:00", 7.2), ("a", f"{day} 00:20:00", 7.3), ("a", f"{day} 00:15:00", 11.0), ("b", f"{day} 00:20:00", 4.0)]
    three = [("a", f"{day} 00:45:00", 5.0), ("a", f"{day} 00:02:00", 99.0), ("b", None, 1.0), ("b", f"{day} 00:45:00", None)]
    end = [[("z", f"{day} 0{h}:00:00", 1.0)] for h in (5, 6, 7)]
    got = _batches(spark, tmp_path, [one, two, three, *end], f"{tmp_path}/c")
    kept = [r for r in (*one, *two, *three) if r[1] and r[2] is not None and r[2] != 99.0]
    table = spark.createDataFrame(kept, "subject string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    want = [(r["subject"], str(r["ts"]), r["value"], round(r["smoothed"], 9)) for r in fusion.smooth(table, "value", "smoothed").orderBy("subject", "ts").collect()]
    assert [r for r in got if r[0] != "z"] == want
    left = spark.read.format("statestore").option("stateVarName", "trail").load(f"{tmp_path}/c").select("key.subject").distinct().collect()
    assert {r[0] for r in left} <= {"z"}


def test_pairs_within_seconds(spark, tmp_path):
    r = _stream(spark, tmp_path, ROWS, "subject string, ts string, glucose double", "p")
    w = _stream(spark, tmp_path, [("a", "2024-01-01 00:04:50", 1.0), ("a", "2024-01-01 00:12:00", 2.0)], "subject string, ts string, x double", "w").withColumnRenamed("ts", "t_end")
    got = [(str(x["ts"]), x["x"]) for x in _run(live.pair_signals(r, w, 60), "pairs")]
    assert got == [("2024-01-01 00:05:00", 1.0)]
