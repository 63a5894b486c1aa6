import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import features, signals


def ecg(fs=250, seconds=16, bpm=72):
    n, x = fs * seconds, np.zeros(fs * seconds)
    t = np.arange(n) / fs
    for beat in np.arange(0.5, seconds - 0.5, 60 / bpm):
        for at, height, width in ((0, 1.0, 0.012), (-0.03, -0.15, 0.012), (0.03, -0.2, 0.012), (0.25, 0.3, 0.04)):
            x += height * np.exp(-(((t - beat - at) / width) ** 2))
    return x


def frame(spark, rows):
    return signals.samples(spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "w int, x array<double>"), "w")


def test_heart_beats(spark):
    s = frame(spark, [ecg(), ecg(bpm=60), np.zeros(20)])
    found = signals.r_peaks(s, "w", 250)
    got = {r["w"]: r for r in signals.beat_summary(signals.beats(s, found, "w", 250), "w").collect()}
    assert abs(got[0]["hr_mean"] - 72) < 2 and abs(got[1]["hr_mean"] - 60) < 2 and 2 not in got
    assert 0.2 < got[0]["qt_mean"] < 0.4 and math.isfinite(got[0]["qtc"]) and got[0]["t_amp_mean"] == pytest.approx(0.3, abs=0.05)
    assert got[0]["qrs_amp_mean"] == pytest.approx(1.15, abs=0.2)


def test_pulses(spark):
    t = np.arange(64 * 16) / 64
    x = np.sin(2 * np.pi * 1.2 * t) + 0.3 * np.sin(4 * np.pi * 1.2 * t + 0.5)
    s = frame(spark, [x])
    found = signals.peaks(s, "w", "x", F.lit(float(np.median(x) + 0.2 * x.std())), int(0.3 * 64))
    row = signals.pulse_shape(s, found, "w", 64).agg(F.avg("rise").alias("rise"), F.avg("amp").alias("amp"), F.count("*").alias("n")).first()
    assert 0.05 < row["rise"] < 0.5 and row["n"] > 10 and row["amp"] > 1


def test_entropies_meet_numpy(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=64)
    s = frame(spark, [x, np.ones(64)])
    spec = signals.spectrum(s, "w", 64)
    p = np.abs(np.fft.fft(x)) ** 2
    regular = np.fft.ifft(np.where(p > p.mean(), np.fft.fft(x), 0)).real
    c0 = {r["w"]: r["c0"] for r in signals.c0_complexity(spec, "w", 64).collect()}
    assert c0[0] == pytest.approx(((x - regular) ** 2).sum() / (x**2).sum()) and c0[1] == pytest.approx(0)
    h, _ = np.histogram(x, 64)
    q = h[h > 0] / 64
    se = {r["w"]: r["se"] for r in signals.amplitude_entropy(s, "w").collect()}
    assert se[0] == pytest.approx(-(q * np.log2(q)).sum()) and se[1] == 0
    assert {r["w"]: r["ke"] for r in signals.sample_entropy(s.where("w = 1"), "w").collect()}[1] == pytest.approx(0, abs=0.2)


def test_wavelet_keeps_energy_inside(spark):
    x = np.random.default_rng(3).normal(size=256)
    d = signals.wavelet_details(frame(spark, [x]), "w", 1).orderBy("o").collect()
    low = np.array(signals.DB4)
    assert low.sum() == pytest.approx(math.sqrt(2)) and (low**2).sum() == pytest.approx(1)
    high = np.array([(-1) ** (j + 1) * h for j, h in enumerate(low[::-1])])
    want = np.convolve(np.concatenate((x[:7][::-1], x, x[-7:][::-1])), high)[7:][1 : 256 + 7 : 2]
    assert [r["x"] for r in d] == pytest.approx(list(want[: len(d)]))


def test_usable(spark):
    w = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, math.nan]), (3, None), (4, [])], "w int, x array<double>")
    assert [r["reason"] for r in signals.usable(w).orderBy("w").collect()] == [None, "flat", "not finite", "missing", "missing"]


def test_reconstructions_add_up(spark):
    x = np.random.default_rng(5).normal(size=100)
    r = signals.wavelet_reconstructions(frame(spark, [x, x[:64]]), "w", 3, approximation=True)
    got = r.groupBy("w", "i").agg(F.sum(F.when(F.col("level") != 0, F.col("x"))).alias("back"), F.max(F.when(F.col("level") == 0, F.col("x"))).alias("x"), F.count("*").alias("n")).collect()
    assert len(got) == 164 and all(g["n"] == 5 and g["back"] == pytest.approx(g["x"], abs=1e-9) for g in got)


def test_ten_features_of_a_flat_window(spark):
    got = signals.ten_features(frame(spark, [np.ones(64), np.random.default_rng(6).normal(size=64)]), "w", 64).orderBy("w").collect()
    assert len(got) == 2 and len(got[0]) == 11 and got[0]["sm"] == 0 and got[1]["sm"] > 0


def test_features_of_a_batch_equal_the_native_forms(spark, sf):
    """Every feature of the Arrow pass against the joins of signals, on the signal and on its wavelet levels."""
    w = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 12").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    smooth = w.select("vec_id", F.expr("transform(sequence(1, size(x)), i -> aggregate(slice(x, 1, i), 0D, (a, v) -> a + v))").alias("x"))
    got = {r["vec_id"]: r for r in features.temporal_features(smooth, "vec_id", {"x": "X_"}).collect()}
    assert len(next(iter(got.values())).asDict()) == 81
    levels = signals.wavelet_reconstructions(signals.samples(smooth, "vec_id"), "vec_id", 3).cache()
    for k in (0, 3):
        s = levels.where(F.col("level") == k).select("vec_id", "i", "x")
        spec = signals.spectrum(s, "vec_id", 64)
        native = {"Kur": (signals.moments, "kur"), "Ske": (signals.moments, "ske"), "SM": (signals.hjorth, "sm"), "SC": (signals.hjorth, "sc"), "FD": (signals.higuchi, "fd"), "CD": (signals.correlation_dimension, "cd"), "KE": (signals.sample_entropy, "ke"), "SE": (signals.amplitude_entropy, "se")}
        want = {n: {r["vec_id"]: r[c] for r in f(s, "vec_id").collect()} for n, (f, c) in native.items()}
        want["C0"] = {r["vec_id"]: r["c0"] for r in signals.c0_complexity(spec, "vec_id", 64).collect()}
        want["PSE"] = {r["vec_id"]: r["pse"] for r in signals.spectral_entropy(spec, "vec_id", 64).collect()}
        for name, values in want.items():
            for i, v in values.items():
                assert got[i][f"X_FE{k}_{name}"] == pytest.approx(v, rel=1e-6, abs=1e-9), (k, name, i)


def test_band_pass_keeps_the_band_without_a_shift():
    b, a = features.butterworth(4, 0.5, 40.0, 250.0)
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 250)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 250)))
    assert len(a) == len(b) == 9 and gain(0.5) == pytest.approx(0.5**0.5, rel=1e-4) and gain(40) == pytest.approx(0.5**0.5, rel=1e-6) and gain(8) == pytest.approx(1, abs=1e-3) and gain(0) < 1e-6
    t = np.arange(4000) / 250
    out = features.band_pass(np.array([np.sin(2 * np.pi * 8 * t) + 5 + np.sin(2 * np.pi * 90 * t), np.full(4000, 3.0)]), 0.5, 40.0, 250.0)
    assert np.abs(out[0] - np.sin(2 * np.pi * 8 * t))[1500:-1500].max() < 0.02 and np.abs(out[1]).max() < 1e-6
    assert np.isnan(features.band_pass(np.ones((1, 27)), 0.5, 8.0, 64.0)).all()


def test_wide_rows(spark):
    t = np.arange(1024) / 64
    pulse = np.sin(2 * np.pi * 1.2 * t) + 0.3 * np.sin(2 * np.pi * 2.4 * t + 1)
    r = np.random.default_rng(3)
    rows = [(1, ecg() + r.normal(0, 0.01, 4000), pulse + r.normal(0, 0.01, 1024)), (2, None, pulse), (3, np.zeros(4000), pulse), (4, ecg()[:20], []), (5, ecg(), pulse[:40])]
    df = spark.createDataFrame([(i, *(None if x is None else [float(v) for v in x] for x in p)) for i, *p in rows], "w int, ecg array<double>, ppg array<double>")
    got = {x["w"]: x for x in features.window_rows(df, "w").collect()}
    one = got[1].asDict()
    assert set(got) == {1, 2, 3, 4, 5} and len(one) == 193 + 2 and got[1]["finite"] and not any(got[i]["finite"] for i in (2, 3, 4, 5))
    assert abs(one["ECGm_HR_mean"] - 72) < 5 and one["ECGm_QT_mean"] > 0 and one["ECGm_QTc"] > 0 and 0.05 < one["PPGm_Rise_mean"] < 0.5
    assert got[2]["PPGm_Samp_mean"] is not None and got[2]["ECG_FE0_Kur"] is None and got[5]["PPGm_Samp_mean"] is None
    assert features.window_rows(df.limit(0), "w").count() == 0


def _wide_by_joins(df, key, ecg, ppg):
    clean = features.cleaned(df.select(key, "ecg", "ppg"), {"ecg": ecg, "ppg": ppg})
    beats = features.beat_features(clean.select(key, F.col("ecg").alias("x")).where("x is not null"), key, ecg[2])
    pulses = features.pulse_features(clean.select(key, F.col("ppg").alias("x")).where("x is not null"), key, ppg[2])
    return features.temporal_features(clean, key, {"ecg": "ECG_", "ppg": "PPG_"}).join(beats, key, "left").join(pulses, key, "left")


def test_the_pass_over_batches_equals_the_joins(spark, sf):
    """All 193 features against the native forms, on short windows and on whole ones; one Arrow stage and no exchange."""
    w = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("ecg"))
    short = w.select("vec_id", "ecg", F.reverse("ecg").alias("ppg")), (0.5, 8.0, 64.0), (0.5, 8.0, 64.0)
    r, t = np.random.default_rng(4), np.arange(1024) / 64
    rows = [(i, [float(v) for v in ecg() + r.normal(0, 0.02, 4000)], [float(v) for v in np.sin(2 * np.pi * (1 + 0.1 * i) * t) + 0.3 * np.sin(4 * np.pi * t + i) + r.normal(0, 0.02, 1024)]) for i in range(4)]
    whole = spark.createDataFrame(rows, "vec_id long, ecg array<double>, ppg array<double>"), (0.5, 40.0, 250.0), (0.5, 8.0, 64.0)
    for df, a, b in (short, whole):
        wide = features.window_rows(df, "vec_id", a, b)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
        got = {x["vec_id"]: x.asDict() for x in wide.collect()}
        for x in _wide_by_joins(df, "vec_id", a, b).collect():
            want = x.asDict()
            assert set(want) | {"finite"} == set(got[want["vec_id"]])
            for name, value in want.items():
                assert got[want["vec_id"]][name] == (value if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), name
    assert any(got[i]["ECGm_SDNN"] is not None and got[i]["PPGm_AI_mean"] is not None for i in got)
