"""Trees, ensembles, lasso from sums and the protocol against plain forms."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from rillwork import queries
from rillwork.operators import folds, selection, trees
from rillwork.plans import ensembles, protocol, scoring

from compare import same


def grown(x, y, w, depth, level=0):
    """A tree by trying every split of every node."""
    at = np.flatnonzero(w)
    value = np.average(y[at], weights=w[at])
    if len(at) < 2 or y[at].min() == y[at].max() or level == depth:
        return value
    best = None
    for f in range(len(x)):
        values = np.unique(x[f][at])
        for t in (values[1:] + values[:-1]) / 2:
            left, right = at[x[f][at] <= t], at[x[f][at] > t]
            gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, right))
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, t
    if best is None:
        return value
    _, f, t = best
    return f, t, grown(x, y, np.where(x[f] <= t, w, 0), depth, level + 1), grown(x, y, np.where(x[f] > t, w, 0), depth, level + 1)


def leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [None, 0, 1, 3])
def test_tree_equals_brute_force(depth):
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 3), (2, 2), (40, 4), (70, 50)):
        x, y, w = rng.integers(0, kinds, (3, n)).astype(float), rng.integers(0, 10_000, n).astype(float), rng.integers(0, 3, n).astype(float)
        w[0] = 1
        order = trees.sorted_rows(x)
        got = trees.grow(x, y, w, order[(w > 0)[order]].reshape(3, -1), depth)
        new = rng.integers(-1, kinds + 1, (3, 100)).astype(float)
        want = grown(x, y, w, depth)
        assert got.predict(new) == pytest.approx([leaf(want, c) for c in new.T])
        assert depth is None or got.depth <= depth


def test_neighbouring_doubles_are_split():
    x = np.array([[1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2)]])
    y = np.array([3.0, 1.0, 2.0])
    assert trees.grow(x, y, np.ones(3), trees.sorted_rows(x)).predict(x).tolist() == y.tolist()


def test_boosting_adds_trees_of_residuals():
    rng = np.random.default_rng(6)
    x, y = rng.random((2, 50)), rng.random(50)
    now = np.full(50, y.mean())
    for _ in range(4):
        tree = grown(x, y - now, np.ones(50), 3)
        now = now + 0.5 * np.array([leaf(tree, c) for c in x.T])
    assert trees.boosted(x, y, x, 4, 0.5, 3) == pytest.approx(now)


def table(spark, n=400, subjects=20):
    rng = np.random.default_rng(8)
    x = rng.random((n, 3)).round(2)
    rows = [(f"s{i % subjects}", int(i % 4), float(5 + 3 * a + (b > 0.5) + 0.1 * rng.standard_normal()), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "subject string, fold int, glucose double, a double, b double, c double").withColumn("ts", F.timestamp_seconds(F.monotonically_increasing_id() % 1000 + F.hash("a")))


FEW = {"RandomForest": ensembles.Forest(trees=6, block=4), "GradientBoosting": ensembles.Boosting(rounds=20, rate=0.2), "Bagging": ensembles.Forest(trees=5, seed=7, block=5)}


def test_held_out_rows_are_scored_by_fits_that_have_not_seen_them(spark):
    """A target that only memory can tell is predicted by no fit; shares of the scored rows change nothing."""
    rng = np.random.default_rng(9)
    rows = [(i, o, int(rng.integers(0, 4)), [float(i % 7), float(i % 11)], float(i % 7)) for o in (0, 1) for i in range(300)]
    dealt = spark.createDataFrame(rows, "row long, outer int, held int, x array<double>, y double")
    got = {(r["outer"], r["row"]): r for r in ensembles.held_out_predictions(dealt, FEW, 3).collect()}
    assert len(got) == len(rows) and all(got[o, i]["held"] == h for i, o, h, _, _ in rows)
    assert all(abs(got[o, i]["RandomForest"] - y) < 0.5 for i, o, _, _, y in rows)  # seen in other rows of the same x
    shared = {(r["outer"], r["row"]): r for r in ensembles.held_out_predictions(dealt, FEW, 3, scored=90).collect()}
    assert all(shared[k][m] == pytest.approx(got[k][m]) for k in got for m in FEW)
    noise = dealt.withColumn("x", F.array(F.lit(1.0), F.lit(1.0))).withColumn("y", F.rand(3))
    blind = ensembles.held_out_predictions(noise, FEW, 3).groupBy("outer", "held").agg(F.count_distinct(F.round("Bagging", 9)).alias("n")).collect()
    assert all(r["n"] == 1 for r in blind)
    sampled = ensembles.held_out_predictions(dealt, {"Bagging": FEW["Bagging"]}, 3, rows=60).where("Bagging is null").count()
    assert sampled == 0
    assert ensembles.held_out_predictions(dealt.limit(0), FEW, 3).count() == 0


def test_protocol_and_its_diagnostics(spark):
    rows = table(spark)
    odd = rows.limit(3).withColumn("a", F.lit(None).cast("double")).unionByName(rows.limit(2).withColumn("c", F.lit(float("nan"))))
    predictions, diagnostics = protocol.protocol_tables(rows.unionByName(odd), ["a", "b", "c"], learners=FEW, least=2)
    got = predictions.collect()
    assert len(got) == 400
    truth = np.array([r["glucose"] for r in got])
    assert all(1 - ((truth - [r[m] for r in got]) ** 2).mean() / truth.var() > 0.8 for m in [*FEW, "PlainAverage", "Choquet"])
    assert all(min(r[m] for m in FEW) == r["MinOfModels"] for r in got)
    about = {r["fold"]: r for r in diagnostics.collect()}
    assert set(about) == {0, 1, 2, 3} and all((r["n_train"], r["n_test"]) == (300, 100) for r in about.values())
    assert all("intersection" in r["selection"] and 2 <= r["n_features"] <= 3 and 0.5 < r["r2_Bagging"] <= 1 and not r["degenerate"] and r["equivalent_operator"].startswith("competence") for r in about.values())
    for r in got:
        others = [x["glucose"] for x in got if x["fold"] != r["fold"]]
        if r["fold"] == 0:
            assert r["NoSkillBaseline"] == pytest.approx(np.mean(others))


def test_scores_of_new_rows(spark):
    rows = table(spark)
    new = rows.where("fold = 0").withColumn("b", F.when(F.col("b") > 0.1, F.col("b")))
    got = protocol.fit_and_score(rows.where("fold > 0"), new, ["a", "b", "c"], "glucose", FEW).collect()
    assert len(got) == 100 and {r["reason"] for r in got} == {None, "missing b"}
    good = [r for r in got if r["reason"] is None]
    truth = np.array([r["glucose"] for r in good])
    assert all(r["Choquet"] is None for r in got if r["reason"]) and 1 - ((truth - [r["Choquet"] for r in good]) ** 2).mean() / truth.var() > 0.8


def test_lasso_from_sums_equals_fits_on_rows(spark, sf):
    rows = queries.feature_rows(spark, sf)
    sums = selection.sums_by_fold(folds.hash_fold(rows, 3), queries.FEATURES, "glucose")
    grid = selection.path_of(sum(sums[1:], sums[0]))
    assert grid == pytest.approx(selection.penalty_path(rows, queries.FEATURES, "glucose"), rel=1e-9) and len(grid) == 30
    data = selection.assembled(selection.standardise(rows, queries.FEATURES), queries.FEATURES, "glucose").select("features", "label").cache()
    for penalty in (grid[0] * 1.01, grid[6], grid[20]):
        fit = LinearRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, tol=1e-10).fit(data)
        assert selection.lasso_weights(sums, [penalty])[0] == pytest.approx(fit.coefficients.toArray(), abs=1e-4)
    data.unpersist()
    plan = selection.cross_sums(folds.hash_fold(rows, 3), [*queries.FEATURES, "glucose"], "fold")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert selection.lasso_rank(folds.hash_fold(rows, 3).limit(0), ["l_tax"], "glucose") == [("l_tax", 0.0)]


def test_group_folds_can_be_joined_on(spark):
    """Several rounds for a size, and something downstream that joins on the fold."""
    sizes = [7, 5, 5, 3, 3, 3, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1]
    rows = spark.createDataFrame([(f"s{i:02d}", i * 100 + j) for i, n in enumerate(sizes) for j in range(n)], "subject string, k int")
    dealt = folds.group_fold(rows, 3)
    means = folds.no_skill(dealt, "k").select("fold", "NoSkillBaseline")
    got = dealt.join(F.broadcast(means), "fold").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("s")).collect()
    assert sum(r["n"] for r in got) == sum(sizes) and sum(r["s"] for r in got) == len(sizes) and len(got) == 3


def test_comparison_of_protocols_at_a_larger_size(spark):
    d = "/root/testdata/sf0.01"
    same(queries.QUERIES["protocol_comparison"](spark, d), queries.ORACLE["protocol_comparison"], d)


def test_feature_sets_by_prefix():
    names = ["vec_id", "ECG_FE0_Kur", "ECGm_RR_mean", "PPG_FE1_SE", "PPGm_AI_std"]
    sets = selection.feature_sets(names)
    assert sets["temporal"] == ["ECG_FE0_Kur", "PPG_FE1_SE"] and sets["morphological"] == ["ECGm_RR_mean", "PPGm_AI_std"] and sets["fused"] == sets["temporal"] + sets["morphological"]
    assert sets["ecg_only"] == names[1:3] and sets["ppg_only"] == names[3:]


def test_raw_windows_are_scored_or_refused(spark, sf):
    """Every window comes back, each with predictions or with the reason why not."""
    raw = queries.raw_windows(spark, sf)
    short, long = scoring.usable_windows(raw, 48, 48), scoring.usable_windows(raw, 60, 60)
    assert {r["reason"] for r in short.select("reason").distinct().collect()} == {None, "ecg missing", "ecg too short", "ecg flat", "ecg not finite", "ppg too short"}
    kept = long.where("reason is null").select("ecg", "vec_id").first()
    assert kept["ecg"] == pytest.approx(raw.where(F.col("vec_id") == kept["vec_id"]).first()["ecg"][-60:])
    wide = scoring.wide_windows(raw, "vec_id", 48, 48, (0.5, 8.0, 64.0), (0.5, 8.0, 64.0)).withColumns({"subject": (F.col("vec_id") % 7).cast("string"), "ts": F.timestamp_seconds("vec_id"), "glucose": F.col("ECG_FE0_Kur") + 5})
    names = ["ECG_FE0_Kur", "ECG_FE0_Ske", "ECGm_RR_mean"]
    got = scoring.score_windows(wide, wide.where("vec_id % 3 > 0 and reason is null"), names, "glucose", FEW).collect()
    assert sorted(r["vec_id"] for r in got) == sorted(r["vec_id"] for r in raw.select("vec_id").collect())
    assert all((r["Choquet"] is None) == (r["reason"] is not None) for r in got) and {"missing ECGm_RR_mean", None, "ecg flat"} <= {r["reason"] for r in got}


def test_ablation_over_feature_sets(spark):
    """Sets that hold what the target depends on beat those that don't; the control stands last."""
    rows = table(spark).withColumnsRenamed({"a": "ECG_a", "b": "PPG_b", "c": "ECGm_c"}).where("ECG_a is not null")
    sets = selection.feature_sets(rows.columns)
    got = protocol.feature_ablation(rows, sets, learners=FEW, choose=False).collect()
    assert [r["feature_set"] for r in got][-1] == "none" and len(got) == 6 and got[-1]["n_features"] == 0
    assert [r["r2"] for r in got[:-1]] == sorted(r["r2"] for r in got[:-1])
    by = {r["feature_set"]: r for r in got}
    assert by["fused"]["n_features"] == 3 and by["temporal"]["r2"] > 0.8 > 0.1 > by["morphological"]["r2"] and abs(by["none"]["r2"]) < 0.1


def written(spark, run):
    """Rows that stages write for shuffles while run() runs."""

    def so_far():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = so_far()
    run()
    return sum(n for k, n in so_far().items() if k not in before)


MANY = {"RandomForest": ensembles.Forest(trees=40, block=1), "GradientBoosting": ensembles.Boosting(rounds=2)}


def test_a_row_is_shuffled_once_to_be_scored_by_all_trees(spark):
    """Not once for each block of trees: there are 40, and fits learn from 60 rows."""
    dealt = spark.range(4000).select(F.col("id").alias("row"), F.lit(0).alias("outer"), (F.col("id") % 4).cast("int").alias("held"), F.array(F.col("id") % 7 + 0.5).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert 4000 < written(spark, lambda: ensembles.held_out_predictions(dealt, MANY, 3, rows=60)) < 3 * 4000 + 44 * 200


def test_packed_trees_predict_what_trees_do():
    rng = np.random.default_rng(11)
    x, y = np.vstack([rng.integers(0, 9, (2, 300)), rng.random((1, 300))]), rng.random(300)
    new = np.vstack([rng.integers(-1, 10, (2, 500)), rng.random((1, 500))])
    new[0, :5], new[2, 5] = np.nan, np.inf
    made = {"a": trees.forest(x, y, 5, (1,)), "b": trees.boosting(x, y, 4, 0.5, 3), "c": trees.forest(x[:, :1], y[:1], 2, (2,))}
    groves = trees.Groves({k: [trees.pack(v[:2]), trees.pack(v[2:])] if len(v) > 2 else [trees.pack(v)] for k, v in made.items()}, 3)
    got = groves.sums(np.ascontiguousarray(new.T))
    assert all(got[k] == pytest.approx(sum(t.predict(new) for t in v)) for k, v in made.items()) and max(t.depth for t in made["a"]) > trees.Groves.FIRST + trees.Groves.EVERY
    assert got["b"] == pytest.approx(trees.boosted(x, y, new, 4, 0.5, 3)) and trees.Groves({}, 3).sums(new.T) == {}


def test_new_rows_are_shuffled_once_and_keep_their_columns(spark):
    """Training rows go to their folds and to the trees, new rows to the trees, however many blocks there are; new rows'
    columns may have any names."""
    rows = table(spark, 2000)
    new = rows.where("fold = 0").withColumns({"x": F.lit("own"), "held": F.lit(-1), "whole": F.struct("a", "b")})
    got = []
    n = written(spark, lambda: got.extend(protocol.fit_and_score(rows.where("fold > 0"), new, ["a", "b", "c"], "glucose", {"RandomForest": MANY["RandomForest"], **{k: FEW[k] for k in ("GradientBoosting", "Bagging")}}).collect()))
    assert n < 45 * 1500 + 12 * 2000  # 41 blocks learn from all 1,500, here fewer than a fit's bound
    assert len(got) == 500 and all((r["x"], r["held"], r["whole"]["a"]) == ("own", -1, r["a"]) and r["Choquet"] is not None for r in got)
