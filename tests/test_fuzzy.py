import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rillwork.functions import fuzzy
from rillwork.functions.zones import zone
from rillwork.operators import align, folds, fusion
from rillwork.operators import readings as rd


@pytest.mark.parametrize(
    "g, lam, weights",
    [
        ((0.01,) * 3, 846.242942, (0.01, 0.094624, 0.895376)),
        ((0.05,) * 3, 57.749644, (0.05, 0.194374, 0.755626)),
        ((0.10,) * 3, 15.413813, (0.10, 0.254138, 0.645862)),
        ((0.20,) * 3, 2.807764, (0.20, 0.312311, 0.487689)),
        ((1 / 3,) * 3, 0.0, (1 / 3,) * 3),
        ((0.8, 0.6, 0.4), -0.928333, (0.8, 0.154400, 0.045600)),
        ((0.689, 0.745, 0.689), -0.969355, None),
        ((0.019659235, 0.01, 0.01), 584.656069, (0.019659235, None, 0.855402)),
    ],
)
def test_lambda_and_weights(spark, g, lam, weights):
    df = spark.createDataFrame([g], "a double, b double, c double")
    arr = F.array("a", "b", "c")
    closed, any_n = fuzzy.sugeno_lambda3(*map(F.col, "abc")), fuzzy.sugeno_lambda(arr)
    row = df.select(closed.alias("l3"), any_n.alias("l"), fuzzy.rank_weights(arr, closed).alias("w")).first()
    assert row["l3"] == pytest.approx(lam, rel=1e-6, abs=1e-6)
    assert row["l"] == pytest.approx(lam, rel=1e-6, abs=1e-6)
    assert sum(row["w"]) == pytest.approx(1)
    for got, want in zip(row["w"], weights or (None,) * 3, strict=True):
        assert want is None or got == pytest.approx(want, abs=1e-6)


def test_choquet_hand_example_and_properties(spark):
    rows = [(*v, *g) for v in itertools.permutations((9.0, 7.0, 5.0)) for g in [(0.8, 0.6, 0.4)]]
    df = spark.createDataFrame([(9.0, 7.0, 5.0, 0.8, 0.6, 0.4), (4.0, 4.0, 4.0, 0.2, 0.3, 0.1), *rows], "v1 double, v2 double, v3 double, g1 double, g2 double, g3 double")
    lam = fuzzy.sugeno_lambda3(*map(F.col, ("g1", "g2", "g3")))
    got = [r[0] for r in df.select(fuzzy.choquet(fuzzy.pairs(["v1", "v2", "v3"], ["g1", "g2", "g3"]), lam)).collect()]
    assert got[0] == pytest.approx(8.5088, abs=1e-4)
    assert got[1] == pytest.approx(4.0)
    assert all(5 - 1e-9 <= x <= 9 + 1e-9 for x in got[2:])
    swapped = df.select(fuzzy.choquet(fuzzy.pairs(["v2", "v1", "v3"], ["g2", "g1", "g3"]), lam)).collect()
    assert [r[0] for r in swapped] == pytest.approx(got)


def test_zones(spark):
    cases = [(5.0, 5.0, "A"), (6.0, 6.5, "A"), (2.2, 16.7, "E"), (2.8, 16.7, "D"), (22.2, 2.8, "D"), (12.0, 7.0, "B"), (4.0, 9.0, "C"), (5.0, math.nan, None), (None, 5.0, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "y double, p double")
    assert [r[0] for r in df.select(zone(F.col("y"), F.col("p"))).collect()] == [z for *_, z in cases]


def test_group_folds_by_size(spark):
    n = {"c1s01": 2541, "c1s02": 3143, "c1s03": 3110, "c1s04": 2500, "c1s05": 3345, "c2s01": 3423, "c2s02": 2719, "c2s03": 2654, "c2s04": 3754, "c2s05": 3641}
    rows = spark.createDataFrame(list(n.items()), "subject string, k int").select("subject", F.explode(F.sequence(F.lit(1), "k")))
    dealt = folds.group_fold(rows, 5).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("s")).orderBy("fold").collect()
    assert [r["n"] for r in dealt] == [6254, 6182, 6077, 6064, 6253] and all(r["s"] == 2 for r in dealt)
    loso = {r["subject"]: r["fold"] for r in folds.loso_fold(rows).select("subject", "fold").distinct().collect()}
    assert loso["c2s04"] == 1 and loso["c1s04"] == 10
    with pytest.raises(ValueError):
        folds.splits(rows, "other")


def test_group_folds_follow_one_rule_at_every_size(spark):
    r = random.Random(4)
    for _ in range(300):
        k, n = r.randint(1, 6), sorted((r.choice((1, 2, 3, 5, 40, 41)) for _ in range(r.randint(0, 60))), reverse=True)
        load, want = [0] * k, []
        for m in n:
            f = load.index(min(load))
            load[f] += m
            want.append(f + 1)
        got = [c[i % len(c)] for _, a, b, c in folds.deal_sizes([(m, n.count(m)) for m in sorted(set(n), reverse=True)], k) for i in range(b - a)]
        assert got == want
    many = spark.range(1_000_050, numPartitions=4).select(F.format_string("s%07d", "id").alias("subject"))
    dealt = {x["fold"]: (x["n"], x["first"]) for x in folds.group_fold(many, 5).groupBy("fold").agg(F.count("*").alias("n"), F.min("subject").alias("first")).collect()}
    assert dealt == {f: (200_010, f"s{f - 1:07d}") for f in range(1, 6)}


def test_smoothing(spark):
    rows = [("a", f"2024-01-01 00:{5 * i:02d}:00", v) for i, v in enumerate((7.0, 7.2, 7.1, 11.0, 7.3))] + [("a", "2024-01-01 00:45:00", 5.0), ("a", "2024-01-01 01:00:00", 6.0)]
    df = spark.createDataFrame(rows, "subject string, ts string, glucose double").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = [r[0] for r in fusion.smooth(df, "glucose", "s").orderBy("ts").select("s").collect()]
    assert got[:5] == pytest.approx([7.0, 7.028571, 7.057143, 7.638689, 7.683388], abs=1e-6)
    assert got[5] == 5.0 and 5.0 < got[6] < 6.0
    assert fusion.trailing_lambda(spark, 5, 1 / 7)[1:] == pytest.approx([35, 7, 2.724355, 1.182717], rel=1e-6)


def test_clean_readings_drops_what_is_no_number(spark):
    raw = spark.createDataFrame([("a", "2022-06-08 13:00:00", "EGV", "180.18"), ("a", "2022-06-08 13:05:00", "EGV", "Low"), ("a", "2022-06-08 13:06:00", "Alert", None), ("a", None, "EGV", "120")], "u string, t string, k string, v string")
    got = rd.clean_readings(raw.withColumn("t", F.to_timestamp_ntz("t")), "u", "t", "k", "v", ["EGV"]).collect()
    assert [r["glucose"] for r in got] == pytest.approx([10.0])


def test_clock_follows_daylight_saving(spark):
    t = spark.createDataFrame([(1654713165,), (1667714400,), (1667718000,)], "e long").select(F.from_utc_timestamp(F.timestamp_seconds("e"), "America/Chicago").cast("string")).collect()
    assert [r[0] for r in t] == ["2022-06-08 13:32:45", "2022-11-06 01:00:00", "2022-11-06 01:00:00"]
    scores = spark.createDataFrame([("a", "x", 10), ("a", "y", 3), ("b", "x", 9), ("b", "y", 6), ("c", "x", 4), ("c", "y", 0)], "subject string, zone string, matches long")
    got = {r["subject"]: r["zone"] for r in align.clock_winner(scores, ["x", "y"]).collect()}
    assert got == {"a": "x", "b": None, "c": None}


def test_window_before_edges(spark):
    s = spark.range(100).select(F.lit("s").alias("session_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("value"))
    want = spark.createDataFrame([("s", 0), ("s", 39), ("s", 40), ("s", 100), ("s", 101)], "session_id string, end_idx long")
    got = {r["end_idx"]: r["window"] for r in align.window_before(want, align.chunked(s, 16), 40, 16).collect()}
    assert sorted(got) == [40, 100] and got[100] == [float(i) for i in range(60, 100)]


def test_sql_functions_equal_the_expressions(spark):
    from rillwork.functions import sql

    sql.register(spark)
    sql.register(spark)
    rows = spark.createDataFrame([([0.01, 0.01, 0.01],), ([0.8, 0.6, 0.4],), ([0.2, 0.3, 0.5],), ([0.1, 0.2],), ([1e-6, 1e-6, 1e-6],)], "g array<double>")
    got = spark.sql("SELECT g, sugeno_lambda(g) AS lam, choquet(array(9D, 7D, 5D), array(.8D, .6D, .4D), -0.928333D) AS c, owa_weights(0.2D, 3, 2.807764D) AS w FROM {rows}", rows=rows).withColumn("want", fuzzy.sugeno_lambda(F.col("g"))).collect()
    assert all(r["lam"] == pytest.approx(r["want"], rel=1e-6, abs=1e-9) for r in got)
    assert got[0]["c"] == pytest.approx(8.5088, abs=1e-4) and got[0]["w"] == pytest.approx([0.2, 0.312311, 0.487689], abs=1e-5)
    letters = spark.sql("SELECT parkes_zone(5D, 5D) AS a, parkes_zone(2.2D, 16.7D) AS e, parkes_zone(12D, 7D) AS b, parkes_zone(double('NaN'), 1D) AS n, parkes_zone(NULL, 1D) AS m, in_zones(12D, 7D, 'AB') AS i").first()
    assert tuple(letters) == ("A", "E", "B", None, None, 1.0)
