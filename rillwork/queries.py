"""Registered queries: each reads the given tables and applies the library's operators to whole tables.

`events` stands for readings (user, time, value in mg/dL), its runs of one type for recording sessions, `embeddings` for
one-second signal windows of 64 samples, `lineitem` for a table of features with a target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import oracle
from rillwork.functions import fuzzy, grade, sql
from rillwork.functions.zones import MGDL, zone
from rillwork.operators import align, features, folds, fusion, selection, signals
from rillwork.operators import readings as rd
from rillwork.plans import protocol, scoring
from rillwork.sources.recordings import resume

MODELS = rd.MODELS
METHODS = [*MODELS, "PlainAverage", "WeightedAverage", "Choquet", "MinOfModels", "NoSkillBaseline"]
#: Minutes between readings of one run in `events`, whose median gap is about seven hours.
GAP = 1440
ZONES = ["America/Chicago", "America/New_York", "America/Denver", "America/Los_Angeles", "UTC"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "ship_month", "ship_day", "ship_weekday", "part_mod", "supp_mod"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed number of places, so that sums taken in another order compare equal."""
    return df.select(*[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def readings(spark: SparkSession, d: str) -> DataFrame:
    return rd.clean_readings(table(spark, d, "events"), "user_id", "ts", "event_type", "value")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return folds.hash_fold(rd.causal_predictions(readings(spark, d)), 5)


def wide(spark: SparkSession, d: str) -> DataFrame:
    """All methods' predictions and the control for every reading but a subject's first."""
    rows = predictions(spark, d)
    out = fusion.fuse(rows, fusion.fold_densities(rows, MODELS), MODELS)
    return out.join(F.broadcast(folds.no_skill(rows).select("fold", "NoSkillBaseline")), "fold")


def long(spark: SparkSession, d: str) -> DataFrame:
    return grade.to_long(wide(spark, d), METHODS, ["subject", "ts", "glucose", "fold"])


def reading_clean(spark, d):
    return rounded(rd.clean_readings(table(spark, d, "events"), "user_id", "ts", "event_type", "value", ["view", "click"]))


def subject_summary(spark, d):
    g = F.col("glucose")
    return rounded(readings(spark, d).groupBy("subject").agg(F.count("*").alias("n"), F.min(g).alias("lo"), F.max(g).alias("hi"), F.stddev_samp(g).alias("sd"), F.count_distinct(g).alias("kinds")))


def top_subjects(spark, d):
    n = readings(spark, d).groupBy("subject").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "subject").limit(10)


def contiguous_runs(spark, d):
    return rounded(rd.runs(readings(spark, d), GAP).groupBy("subject", "run").agg(F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count("*").alias("n"), F.avg("glucose").alias("mean")))


def day_index(spark, d):
    return rd.days(readings(spark, d)).select("subject", "ts", "ordinal", "day_no", "label")


def capped_per_day(spark, d):
    rows = readings(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return rounded(rd.cap_per_group(rows, ["subject", "day"], ["ts"], 2)).select("subject", "day", "ts", "glucose")


def dedupe_first(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("subject"), F.to_date("ts").cast("string").alias("day"), "event_id", "event_type")
    return rd.keep_first(rows, ["subject", "day"], ["event_id"])


def fold_hash(spark, d):
    return folds.hash_fold(readings(spark, d), 5).select("subject", "ts", "fold")


def fold_group(spark, d):
    return folds.group_fold(readings(spark, d), 5).groupBy("subject", "fold").agg(F.count("*").alias("n"))


def fold_loso(spark, d):
    return folds.loso_fold(readings(spark, d)).groupBy("subject", "fold").agg(F.count("*").alias("n"))


def holdout_split(spark, d):
    dealt = folds.hash_fold(readings(spark, d), 5, 7)
    return rounded(dealt.groupBy((F.col("fold") == 0).alias("test")).agg(F.count("*").alias("n"), F.avg("glucose").alias("mean")))


def noskill_baseline(spark, d):
    return rounded(folds.no_skill(folds.hash_fold(readings(spark, d), 5)))


def causal_predictions(spark, d):
    return rounded(predictions(spark, d)).select("subject", "ts", "glucose", *MODELS, "fold")


def fold_densities(spark, d):
    return rounded(fusion.fold_densities(predictions(spark, d), MODELS))


def fused_predictions(spark, d):
    return rounded(wide(spark, d)).select("subject", "ts", "fold", *METHODS)


def predictions_long(spark, d):
    return rounded(long(spark, d).groupBy("fold", "method").agg(F.count("*").alias("n"), F.sum("pred").alias("total")), 4)


def sugeno_lambda3(spark, d):
    by = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.avg((F.col("o_orderpriority").substr(1, 1) == k).cast("double")).alias(c) for k, c in (("1", "a"), ("2", "b"), ("3", "c"))])
    g = [fuzzy.density(F.col(c)).alias(c) for c in "abc"]
    return rounded(by.select("o_custkey", *g).withColumn("lambda", fuzzy.sugeno_lambda3(*map(F.col, "abc"))), 5)


def sugeno_lambda_any(spark, d):
    got = table(spark, d, "lineitem").select(F.col("l_discount").cast("double").alias("l_discount")).where("l_discount > 0").distinct()
    each = got.withColumn("n", F.explode(F.array(*map(F.lit, (2, 3, 4, 5)))))
    return rounded(each.select("l_discount", "n", fuzzy.sugeno_lambda(F.array_repeat(F.col("l_discount"), F.col("n"))).alias("lambda")), 4)


def choquet3(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v1"), (F.col("l_extendedprice") / 1000).alias("v2"), (F.col("l_tax") * 100).alias("v3"), fuzzy.density(F.col("l_discount")).alias("g1"), F.lit(0.3).alias("g2"), fuzzy.density(F.col("l_tax")).alias("g3"))
    lam = fuzzy.sugeno_lambda3(*map(F.col, ("g1", "g2", "g3")))
    return rounded(rows.withColumn("lam", lam).select("l_orderkey", "l_linenumber", fuzzy.choquet(fuzzy.pairs(["v1", "v2", "v3"], ["g1", "g2", "g3"]), F.col("lam")).alias("fused")), 8)


def owa_weights(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_discount").alias("g")).where("g > 0").distinct()
    w = fuzzy.owa_weights(F.col("g"), 3, F.col("lam"))
    lam = g.withColumn("lam", fuzzy.sugeno_lambda3(F.col("g"), F.col("g"), F.col("g"))).withColumn("w", w)
    return rounded(lam.select("g", "lam", *[F.col("w")[i].alias(f"w{i + 1}") for i in range(3)]))


def degeneracy_report(spark, d):
    rows = fusion.fold_densities(predictions(spark, d), MODELS)
    g = F.array(*[F.col(f"g_{m}") for m in MODELS])
    return rounded(rows.select("fold", *[v.alias(k) for k, v in fuzzy.degeneracy(g, F.col("lambda"), 3).items()]))


def density_sweep(spark, d):
    g = table(spark, d, "lineitem").select(((F.col("l_discount") + F.col("l_tax")) / 2).alias("g")).where("g > 0.004 and g < 1 / 3D").select(F.round("g", 6).alias("g")).distinct()
    lam = g.withColumn("lam", fuzzy.sugeno_lambda3(F.col("g"), F.col("g"), F.col("g")))
    arr = F.array(F.col("g"), F.col("g"), F.col("g"))
    report = fuzzy.degeneracy(arr, F.col("lam"), 3)
    return rounded(lam.select("g", "lam", report["weight_on_min"].alias("weight_on_min"), report["operator"].alias("operator")), 5)


def temporal_choquet(spark, d):
    named = rd.runs(readings(spark, d), GAP)
    return rounded(fusion.smooth(named, "glucose", "smoothed", 7, 1 / 7), 5).select("subject", "ts", "run", "glucose", "smoothed")


def temporal_sweep(spark, d):
    """Smoothing variants of each model, fused and graded, beside the raw models: one trail and one aggregate for all."""
    rows = rd.runs(predictions(spark, d), GAP)
    variants = {"1/7": 1 / 7, "0.20": 0.20, "0.35": 0.35}
    wide = fusion.smoothings(rows, MODELS, {f"{name} {m}": (m, g) for name, g in variants.items() for m in MODELS})
    each = F.array(*[F.struct(F.lit(name).alias("variant"), *[F.col(f"`{name} {m}`" if name != "raw" else m).alias(m) for m in MODELS]) for name in ("raw", *variants)])
    apart = wide.select("fold", "glucose", F.explode(each).alias("v")).select("fold", "glucose", "v.*")
    graded = fusion.fuse(apart, fusion.fold_densities(rows, MODELS), MODELS).groupBy("variant").agg(grade.rmse(F.col("glucose"), F.col("Choquet")).alias("rmse"), grade.mard(F.col("glucose"), F.col("Choquet")).alias("mard"))
    base = F.max(F.when(F.col("variant") == "raw", F.col("rmse"))).over(Window.partitionBy())
    return rounded(graded.withColumn("delta", F.col("rmse") - base), 4)


def zone_label(spark, d):
    return predictions(spark, d).select("subject", "ts", zone(F.col("glucose"), F.col("LastReading")).alias("zone"))


def zone_pct_by_method(spark, d):
    return rounded(long(spark, d).groupBy("method").agg(*[grade.zone_percent(F.col("glucose"), F.col("pred"), z).alias(f"zone_{z.lower()}") for z in "ABCDE"]))


def zone_distribution(spark, d):
    z = long(spark, d).withColumn("zone", zone(F.col("glucose"), F.col("pred")))
    return z.groupBy("method").pivot("zone", list("ABCDE")).count().na.fill(0)


def grade_pooled(spark, d):
    s = grade.summarise(long(spark, d))
    return rounded(s.withColumn("place", F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))).orderBy("place"))


def grade_per_fold_avg(spark, d):
    return rounded(grade.per_fold(long(spark, d)))


def grade_by_subject(spark, d):
    return rounded(grade.summarise(long(spark, d), "subject"))


def fusion_vs_min(spark, d):
    return rounded(grade.fusion_audit(wide(spark, d), "Choquet", MODELS))


def verdict_vs_control(spark, d):
    return rounded(grade.against_control(grade.summarise(long(spark, d)), "NoSkillBaseline"))


def best_single(spark, d):
    return rounded(grade.summarise(long(spark, d)).where(F.col("method").isin(MODELS)).agg(F.min_by("method", "rmse").alias("method"), F.min("rmse").alias("rmse")))


def reliability_weighted(spark, d):
    rows = grade.to_long(predictions(spark, d), MODELS, ["subject", "ts", "glucose"])
    return rounded(fusion.reliability_weighted(rows)).select("subject", "ts", "pred")


def zone_vs_r2(spark, d):
    return rounded(grade.summarise(long(spark, d)).select("method", "zone_ab", "r2"))


def headline(spark, d):
    return rounded(grade.headline(grade.summarise(long(spark, d)), "Choquet", "NoSkillBaseline", MODELS))


def fold_coverage(spark, d):
    """How many folds each subject's readings are dealt to."""
    return predictions(spark, d).groupBy("subject").agg(F.count_distinct("fold").alias("n_folds"), F.count("*").alias("n"))


def subject_coverage(spark, d):
    """Customers that have predictions."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("subject"))
    return grade.coverage(asked, predictions(spark, d), "subject")


def finite_moments(spark, d):
    """Moments of each event type's values, a missing one being NaN as in exported feature tables."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
    return rounded(table(spark, d, "events").groupBy("event_type").agg(*grade.finite_moments(value)))


def fold_sizes(spark, d):
    rows = folds.hash_fold(readings(spark, d), 5)
    return folds.no_skill(rows).select("fold", "n_train", "n_test")


def protocol_comparison(spark, d):
    """R2 of the causal models and the control under each of three splits, one column a split."""
    rows, out = rd.causal_predictions(readings(spark, d)), None
    for name in ("random_window", "subject_aware", "loso"):
        dealt = folds.splits(rows, name)
        both = dealt.join(F.broadcast(folds.no_skill(dealt).select("fold", "NoSkillBaseline")), "fold")
        part = grade.to_long(both, [*MODELS, "NoSkillBaseline"], ["glucose"]).withColumn("protocol", F.lit(name))
        out = part if out is None else out.unionByName(part)
    got = out.groupBy("method").pivot("protocol", ["random_window", "subject_aware", "loso"]).agg(grade.r2(F.col("glucose"), F.col("pred")))
    return rounded(got)


def ablation(spark, d):
    """The fused prediction from sets of two models and from all three, the control last."""
    rows = predictions(spark, d)
    names = {"no_last": MODELS[1:], "no_trailing": [MODELS[0], MODELS[2]], "no_past": MODELS[:2], "all": MODELS}
    base = rows.join(F.broadcast(folds.no_skill(rows).select("fold", "NoSkillBaseline")), "fold")
    cols = [(sum((F.col(m) for m in ms[1:]), F.col(ms[0])) / len(ms)).alias(n) for n, ms in names.items()]
    got = grade.summarise(grade.to_long(base.select("glucose", "NoSkillBaseline", *cols), [*names, "NoSkillBaseline"], ["glucose"]))
    sizes = F.create_map(*[x for n, ms in names.items() for x in (F.lit(n), F.lit(len(ms)))])
    return rounded(got.select("method", F.coalesce(F.element_at(sizes, F.col("method")), F.lit(0)).alias("n_models"), "r2", "zone_ab").orderBy(F.col("method") == "NoSkillBaseline", "r2"))


def sessions(spark, d, kind: str) -> DataFrame:
    """Recordings: a user's runs of one event type."""
    e = table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("subject"), "ts")
    made = rd.runs(e, 3 * GAP).withColumn("session_id", F.concat_ws("-", F.lit(kind), F.col("run").cast("string"))).withColumn("device", F.lit(kind))
    return align.catalogue(made)


def session_catalogue(spark, d):
    return sessions(spark, d, "view").unionByName(sessions(spark, d, "click"))


def _purchases(spark, d):
    return rd.clean_readings(table(spark, d, "events"), "user_id", "ts", "event_type", "value", ["purchase"])


def reading_in_session(spark, d):
    got = align.range_join(_purchases(spark, d), sessions(spark, d, "view"), "subject", "ts", "t_start", "t_end", 86_400)
    return got.select("subject", "ts", "session_id", "n")


def first_covering_session(spark, d):
    every = sessions(spark, d, "view").unionByName(sessions(spark, d, "click"))
    got = align.range_join(_purchases(spark, d), every, "subject", "ts", "t_start", "t_end", 86_400)
    return align.first_covering(got, ["subject", "ts"]).select("subject", "ts", "session_id")


def both_modalities(spark, d):
    return rounded(align.both_modalities(_purchases(spark, d), sessions(spark, d, "view"), sessions(spark, d, "click"), 86_400))


def dropped_windows(spark, d):
    """Readings and how many of them are left with both modalities, by subject."""
    all_of = _purchases(spark, d).groupBy("subject").agg(F.count("*").alias("candidates"))
    kept = align.both_modalities(_purchases(spark, d), sessions(spark, d, "view"), sessions(spark, d, "click"), 86_400).groupBy("subject").agg(F.count("*").alias("kept"))
    k = F.coalesce("kept", F.lit(0).cast("long"))
    return all_of.join(kept, "subject", "left").select("subject", "candidates", k.alias("kept"), (F.col("candidates") - k).alias("dropped"))


def window_before(spark, d):
    """The four values before each purchase among its user's values in time order."""
    order = Window.partitionBy("session_id").orderBy("ts")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_type", "value").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    chunks = align.chunked(e.select("session_id", "idx", "value"), 16)
    wanted = e.where("event_type = 'purchase'").select("session_id", F.col("idx").alias("end_idx"))
    w = align.window_before(wanted, chunks, 4, 16)
    return rounded(w.select("session_id", "end_idx", *[F.col("window")[i].alias(f"x{i}") for i in range(4)]))


def _clocks(spark, d):
    """Starts of a user's first twelve views as a UTC clock, and of a local clock three minutes later."""
    e = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").cast("string").alias("subject"), F.col("ts").cast("timestamp").alias("t"))
    local = e.select("subject", (F.from_utc_timestamp("t", "America/Chicago") + F.expr("interval 3 minutes")).cast("timestamp_ntz").alias("t"))
    return e, local


def clock_zone_scores(spark, d):
    return align.clock_scores(*_clocks(spark, d), ZONES, 1200)


def clock_zone_winner(spark, d):
    return align.clock_winner(clock_zone_scores(spark, d), ZONES)


def windows(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _samples(spark, d):
    return signals.samples(windows(spark, d), "vec_id")


def signal_usable(spark, d):
    return signals.usable(windows(spark, d), 0.5).select("vec_id", "reason", F.size("x").alias("n"))


def decimated(spark, d):
    return rounded(windows(spark, d).select("vec_id", F.posexplode(signals.decimate(F.col("x"), 16)).alias("i", "x")))


def last_samples(spark, d):
    w = windows(spark, d).where("size(x) >= 16").select("vec_id", F.slice("x", -16, 16).alias("x"))
    return rounded(w.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"), F.array_max("x").alias("hi")))


def signal_moments(spark, d):
    return rounded(signals.moments(_samples(spark, d), "vec_id"))


def hjorth(spark, d):
    return rounded(signals.hjorth(_samples(spark, d), "vec_id"))


def amplitude_entropy(spark, d):
    return rounded(signals.amplitude_entropy(_samples(spark, d), "vec_id"))


def spectral_entropy(spark, d):
    return rounded(signals.spectral_entropy(signals.spectrum(_samples(spark, d), "vec_id", 64), "vec_id", 64))


def c0_complexity(spark, d):
    return rounded(signals.c0_complexity(signals.spectrum(_samples(spark, d), "vec_id", 64), "vec_id", 64))


def higuchi(spark, d):
    return rounded(signals.higuchi(_samples(spark, d), "vec_id"))


def sample_entropy(spark, d):
    return rounded(signals.sample_entropy(_samples(spark, d), "vec_id"))


def correlation_dim(spark, d):
    return rounded(signals.correlation_dimension(_samples(spark, d), "vec_id", 2), 4)


def dwt_details(spark, d):
    return rounded(signals.wavelet_details(_samples(spark, d), "vec_id", 2))


def dwt_reconstructed(spark, d):
    """Energy of each window's three detail reconstructions and of the window itself."""
    r = signals.wavelet_reconstructions(_samples(spark, d), "vec_id", 3)
    return rounded(r.groupBy("vec_id", "level").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy")))


def ten_features(spark, d):
    """The ten features of each window and of its seven wavelet levels, under their names."""
    return rounded(features.temporal_features(windows(spark, d), "vec_id", {"x": "X_"}))


def window_rows(spark, d):
    """Windows to wide feature rows: the signal as the one channel, and reversed as the other."""
    paired = windows(spark, d).select("vec_id", F.col("x").alias("ecg"), F.reverse("x").alias("ppg"))
    return rounded(features.window_rows(paired, "vec_id", (0.5, 8.0, 64.0), (0.5, 8.0, 64.0)))


def moving_energy(spark, d):
    return rounded(signals.moving_energy(_samples(spark, d), "vec_id", 7)).select("vec_id", "i", "energy", "smooth")


def _peaks(spark, d):
    s = _samples(spark, d)
    stats = s.groupBy("vec_id").agg((F.median("x") + 0.2 * F.stddev_pop("x")).alias("least"))
    return s, signals.peaks(s.join(stats, "vec_id"), "vec_id", "x", F.col("least"), 5)


def signal_peaks(spark, d):
    return rounded(_peaks(spark, d)[1])


def rr_hrv(spark, d):
    return rounded(signals.heart_rate_variability(_peaks(spark, d)[1], "vec_id", 64))


def pulse_shape(spark, d):
    s, found = _peaks(spark, d)
    return rounded(signals.pulse_shape(s, found, "vec_id", 64))


def ecg_beats(spark, d):
    s = _samples(spark, d)
    return rounded(signals.beat_summary(signals.beats(s, signals.r_peaks(s, "vec_id", 64), "vec_id", 64), "vec_id"))


def window_features(spark, d):
    s = _samples(spark, d)
    parts = [signals.moments(s, "vec_id"), signals.hjorth(s, "vec_id"), signals.amplitude_entropy(s, "vec_id")]
    return rounded(signals.side_by_side(parts, "vec_id"))


def feature_rows(spark, d) -> DataFrame:
    li, t = table(spark, d, "lineitem"), F.col("l_shipdate")
    return li.select(
        F.col("l_suppkey").cast("string").alias("subject"), t.alias("ts"), "l_orderkey", (F.col("l_extendedprice") / 1000).alias("glucose"),
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")],
        F.month(t).cast("double").alias("ship_month"), F.dayofmonth(t).cast("double").alias("ship_day"), F.dayofweek(t).cast("double").alias("ship_weekday"),
        (F.col("l_partkey") % 10).cast("double").alias("part_mod"), (F.col("l_suppkey") % 7).cast("double").alias("supp_mod"),
    )


def standardised(spark, d):
    z = selection.standardise(feature_rows(spark, d), FEATURES)
    return rounded(z.groupBy("ship_month").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in FEATURES[:4]]), 3)


def ufs_topk(spark, d):
    got = selection.top_k(selection.f_scores(feature_rows(spark, d), FEATURES, "glucose"), "f", 5)
    return rounded(got.select("feature", "rank", "r"))


def feature_intersection(spark, d):
    """Features among the five best by F score in every one of three folds."""
    rows, out = folds.hash_fold(feature_rows(spark, d), 3), None
    for k in range(3):
        part = selection.top_k(selection.f_scores(rows.where(F.col("fold") != k), FEATURES, "glucose"), "f", 5).select(F.lit(str(k)).alias("set_name"), "feature")
        out = part if out is None else out.unionByName(part)
    return selection.intersection(out, 3, FEATURES)


def rfe(spark, d):
    kept = selection.recursive_elimination(feature_rows(spark, d), FEATURES, "glucose", 4)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def lasso_rank(spark, d):
    ranked = selection.lasso_rank(folds.hash_fold(feature_rows(spark, d), 3), FEATURES, "glucose")
    return spark.createDataFrame(ranked, "feature string, weight double")


def cross_means(spark, d):
    """What lasso learns from: products of all pairs of one, the features and the target, averaged by fold."""
    sums = selection.cross_sums(folds.hash_fold(feature_rows(spark, d), 3), [*FEATURES, "glucose"], "fold")
    n = F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("total"))).over(Window.partitionBy("fold"))
    return rounded(sums.select("fold", "i", "j", (F.col("total") / n).alias("mean")))


def protocol_run(spark, d):
    got = protocol.run_protocol(folds.group_fold(feature_rows(spark, d), 3), FEATURES)
    return grade.summarise(grade.to_long(got, [*protocol.MODELS, "PlainAverage", "WeightedAverage", "Choquet", "MinOfModels", "NoSkillBaseline"], ["glucose"]))


def score_batch(spark, d):
    rows = folds.hash_fold(feature_rows(spark, d), 5)
    new = rows.where("fold = 0").withColumn("l_tax", F.when(F.col("l_tax") > 0.001, F.col("l_tax")))
    got = protocol.fit_and_score(rows.where("fold > 0").drop("fold"), new.drop("fold"), FEATURES, "glucose")
    return got.select("subject", "ts", "glucose", *protocol.MODELS, "PlainAverage", "WeightedAverage", "Choquet", "MinOfModels", "reason")


def sql_scalars(spark, d):
    """Fusion and grades by the functions that spark.sql knows, over lines by return flag."""
    sql.register(spark)
    lines = table(spark, d, "lineitem").selectExpr("l_returnflag", "l_quantity / 3.0D + 2 as y", "l_quantity / 4.0D + 40 * l_discount as p", "l_discount + 0.05D as a", "l_tax + 0.1D as b", "l_quantity / 100.0D as c")
    graded = """SELECT l_returnflag, round(sqrt(squares / n), 6) AS rmse, round(100 * rel, 6) AS mard, round(r2(n, squares, spread), 6) AS r2, round(100 * in_a, 6) AS zone_a, round(100 * in_ab, 6) AS zone_ab, worst
      FROM (SELECT l_returnflag, count(*) AS n, sum(sq_error(y, p)) AS squares, avg(rel_error(y, p)) AS rel, var_pop(y) AS spread, avg(in_zones(y, p, 'A')) AS in_a, avg(in_zones(y, p, 'AB')) AS in_ab, max(parkes_zone(y, p)) AS worst
        FROM {lines} GROUP BY l_returnflag)"""
    fused = """SELECT l_returnflag, round(sum(n * choquet(array(y, p, 10D), array(a, b, c), lam)) / sum(n), 4) AS fused, round(sum(n * lam) / sum(n), 4) AS lam, round(sum(n * element_at(owa_weights(a, 3, lam), 3)) / sum(n), 4) AS last_weight
      FROM (SELECT *, sugeno_lambda(array(a, b, c)) AS lam FROM (SELECT l_returnflag, y, p, a, b, c, count(*) AS n FROM {lines} GROUP BY ALL)) GROUP BY l_returnflag"""
    return spark.sql(graded, lines=lines).join(spark.sql(fused, lines=lines), "l_returnflag")


def sql_window_features(spark, d):
    """The table function over windows, beside the windows' own moments."""
    sql.register(spark)
    got = spark.sql("SELECT key, Kur, Ske, SM FROM window_features(TABLE(SELECT vec_id, x FROM {w}))", w=windows(spark, d))
    return rounded(got.withColumnsRenamed({"Kur": "kur", "Ske": "ske", "SM": "sm"}))


def raw_windows(spark, d) -> DataFrame:
    """Embeddings as windows of two signals of 48 samples, some of which no model can score."""
    x, k = F.col("x"), F.col("vec_id") % 25
    odd = F.when(k == 1, F.slice(x, 1, 40)).when(k == 2, F.array_repeat(F.lit(0.5), 64)).when(k == 3, F.transform(x, lambda v, i: F.when(i != 60, v))).when(k != 4, x)
    return windows(spark, d).select("vec_id", "label", odd.alias("ecg"), F.when(k != 5, F.reverse("x")).otherwise(F.slice(x, 1, 9)).alias("ppg"))


def window_reasons(spark, d):
    """Windows by why they are refused, and the sums of what is kept of the others."""
    got = scoring.usable_windows(raw_windows(spark, d), 48, 48)
    total = lambda c: F.sum(F.when(F.col("reason").isNull(), F.aggregate(c, F.lit(0.0), lambda a, v: a + v)))
    return rounded(got.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), total("ecg").alias("ecg"), total("ppg").alias("ppg")), 4)


def window_scores(spark, d):
    """From raw windows to scores: models learn from four fifths of the windows, the others are scored or refused."""
    raw = raw_windows(spark, d)
    wide = scoring.wide_windows(raw.drop("label"), "vec_id", 48, 48, (0.5, 8.0, 64.0), (0.5, 8.0, 64.0)).join(raw.select("vec_id", "label"), "vec_id")
    rows = wide.withColumns({"subject": F.concat(F.lit("s"), (F.col("vec_id") % 12).cast("string")), "ts": F.timestamp_seconds("vec_id"), "glucose": F.col("label") + 4.0})
    names = selection.feature_sets(wide.columns)["temporal"]
    wide_rows = rows.select("vec_id", "subject", "ts", "glucose", "reason", *names)
    got = scoring.score_windows(wide_rows.where("vec_id % 5 = 0 or reason is not null"), wide_rows.where("vec_id % 5 > 0 and reason is null"), names, "glucose")
    return got.select("vec_id", "glucose", *protocol.MODELS, "PlainAverage", "WeightedAverage", "Choquet", "MinOfModels", "reason")


def resume_pending(spark, d):
    done = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz'1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


def reject_reasons(spark, d):
    """Readings that can't be scored, by reason."""
    g = F.expr("try_cast(value as double)") / MGDL
    reason = F.when(F.col("value").isNull(), "missing").when(g < 0.1, "too low").when(g > 25, "too high")
    return table(spark, d, "events").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_NAMES = """
reading_clean subject_summary top_subjects contiguous_runs day_index capped_per_day dedupe_first fold_hash fold_group fold_loso holdout_split
noskill_baseline causal_predictions fold_densities fused_predictions predictions_long sugeno_lambda3 sugeno_lambda_any choquet3 owa_weights
degeneracy_report density_sweep temporal_choquet temporal_sweep zone_label zone_pct_by_method zone_distribution grade_pooled grade_per_fold_avg
grade_by_subject fusion_vs_min verdict_vs_control best_single reliability_weighted fold_sizes protocol_comparison ablation session_catalogue
reading_in_session first_covering_session both_modalities dropped_windows window_before clock_zone_scores clock_zone_winner signal_usable
decimated last_samples signal_moments hjorth amplitude_entropy spectral_entropy c0_complexity higuchi sample_entropy correlation_dim dwt_details
dwt_reconstructed ten_features window_rows moving_energy signal_peaks rr_hrv pulse_shape ecg_beats window_features standardised ufs_topk feature_intersection rfe lasso_rank cross_means protocol_run score_batch window_reasons window_scores sql_scalars sql_window_features
resume_pending reject_reasons zone_vs_r2 headline fold_coverage subject_coverage finite_moments
"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}
ORACLE = oracle.SQL
