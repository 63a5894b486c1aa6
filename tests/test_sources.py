import io
import zipfile

import pytest

from rillwork.plans import protocol
from rillwork.sources import archives
from rillwork.sources import recordings as rec
from rillwork import queries


def test_exports(spark, tmp_path):
    (tmp_path / "cgm.csv").write_text("Timestamp (x),Event Type,Glucose Value (mg/dL)\n2022-06-08T13:00:00,EGV,180.18\n2022-06-08T13:05:00,EGV,Low\n2022-06-08T13:06:00,Alert,\nbad,EGV,120\n")
    got = rec.read_cgm(spark, str(tmp_path / "cgm.csv"), "001").collect()
    assert len(got) == 1 and got[0]["glucose"] == pytest.approx(10.0)
    (tmp_path / "glucose.csv").write_text("date,time,glucose,type,comments\n2014-10-01,10:00:00,5.5,cgm,\n2014-10-01,10:05:00,x,cgm,\n")
    rows = rec.read_glucose(spark, str(tmp_path / "glucose.csv"), "1").collect()
    assert [(r["subject"], r["glucose"], r["type"]) for r in rows] == [("001", 5.5, "cgm")]


def test_signals(spark, tmp_path):
    for name, text in {"a": "1654713165\n64.0\n1.5\n\n2.5\n", "b": "1654713165\n32.0\n1\n", "c": "x\n64\n1\n"}.items():
        (tmp_path / "e4" / name).mkdir(parents=True)
        (tmp_path / "e4" / name / "BVP.csv").write_text(text)
    good, bad = rec.read_ppg(spark, f"{tmp_path}/e4/*/BVP.csv", "America/Chicago")
    row = good.first()
    assert good.count() == 1 and str(row["t0"]) == "2022-06-08 13:32:45" and row["values"] == [1.5, 2.5]
    assert {r["session_id"]: r["reason"] for r in bad.collect()} == {"b": "wrong rate", "c": "no start"}
    folder = tmp_path / "zephyr" / "2014_10_01-10_09_39"
    folder.mkdir(parents=True)
    (folder / "x_ECG.csv").write_text("Time,EcgWaveform\n" + "".join(f"01/10/2014 10:09:39.{4 * i:03d},{i}\n" for i in range(5)))
    ecg = rec.read_ecg(spark, f"{tmp_path}/zephyr/*/*_ECG.csv").orderBy("idx").collect()
    assert [r["idx"] for r in ecg] == [0, 1, 2, 3, 4] and str(ecg[0]["t0"]) == "2014-10-01 10:09:39"
    names = spark.createDataFrame([("/z/2014_10_01-10_09_39/x.csv",), ("/z/2014_10_01-10_09_39/y.csv",), ("/z/other/x",)], "path string")
    assert [str(r["t_start"]) for r in rec.session_starts_from_names(names).collect()] == ["2014-10-01 10:09:39"]


def test_archives_and_resume(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("e4/1/BVP.csv", "1")
        z.writestr("notes.txt", "n")
    (tmp_path / "s.zip").write_bytes(held.getvalue())
    assert [r["entry"] for r in rec.unzip(spark, f"{tmp_path}/*.zip", "BVP.csv").collect()] == ["e4/1/BVP.csv"]
    work = spark.createDataFrame([("a", "x"), ("b", "x")], "s string, p string")
    rec.write_results({"preds": work.where("s = 'a'").selectExpr("*", "1 AS v")}, f"{tmp_path}/out", ["s", "p"], {"s": "a", "p": "x"})
    assert [r["s"] for r in rec.resume(work, spark.read.parquet(f"{tmp_path}/out/manifest"), ["s", "p"]).collect()] == ["b"]


def test_models_are_saved_and_score(spark, sf, tmp_path):
    rows = queries.feature_rows(spark, sf).where("l_orderkey < 200").cache()
    few = protocol.estimators(trees=2, depth=3, rounds=2)
    models, worth = protocol.final_models(rows, queries.FEATURES, "glucose", few)
    protocol.save_bundle(spark, f"{tmp_path}/b", models, worth, queries.FEATURES)
    again = protocol.load_bundle(spark, f"{tmp_path}/b")
    a, b = (protocol.score_batch(rows, m, w, queries.FEATURES).select("subject", "l_orderkey", "l_linenumber", "Choquet").orderBy("l_orderkey", "l_linenumber").collect() for m, w in ((models, worth), again[:2]))
    assert a == b


def test_sweep_takes_up_what_is_not_complete(spark, sf, tmp_path):
    rows, path, fail = spark.read.parquet(f"{sf}/nation.parquet"), str(tmp_path / "swept"), {"random"}
    configs = [{"protocol": p, "features": f} for p in ("loso", "random") for f in ("001", "002")]

    def run(config):
        if config["protocol"] in fail:
            raise LookupError
        return {"preds": rows.select("n_nationkey")}

    with pytest.raises(LookupError):
        rec.sweep(spark, configs, path, run)
    fail.clear()
    assert rec.sweep(spark, configs, path, run) == configs[2:]
    assert rec.sweep(spark, configs, path, run) == []
    assert rec.sweep(spark, [], path, run) == []
    rec.write_units(rows.selectExpr("n_nationkey", "'half' as protocol", "'003' as features"), f"{path}/preds", ["protocol", "features"])
    got = rec.read_results(spark, path, "preds", ["protocol", "features"])
    n = rows.count()
    assert sorted(map(tuple, got.groupBy("protocol", "features").count().collect())) == [(p, f, n) for p in ("loso", "random") for f in ("001", "002")]


def test_read_features_keeps_ids_as_strings(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("lpad(cast(c_custkey as string), 3, '0') as subject", "c_acctbal").where("c_acctbal > 0")
    rec.write_units(rows, str(tmp_path / "f"), ["subject"])
    got = rec.read_features(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, got.select("subject", "c_acctbal").collect())) == sorted(map(tuple, rows.collect()))
    some = sorted(r.subject for r in rows.collect())[:2]
    assert sorted({r.subject for r in rec.read_features(spark, str(tmp_path / "f"), some).collect()}) == some
    spark.createDataFrame([(7, 1.0), (1234, 2.0)], "subject long, x double").write.parquet(str(tmp_path / "n"))
    assert sorted(r.subject for r in rec.read_features(spark, str(tmp_path / "n")).collect()) == ["007", "1234"]


def test_archives_are_read_in_ranges(spark, tmp_path):
    """Many partitions from many entries and long ones, and sample numbers that hold across them."""
    values = {("001", "e4/b/BVP.csv"): list(range(500)), ("001", "e4/a/BVP.csv"): [0.5, -1.25], ("002", "e4/a/BVP.csv"): list(range(7, 90))}
    for subject in ("001", "002"):
        with zipfile.ZipFile(f"{tmp_path}/{subject}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for (s, entry), v in values.items():
                if s == subject:
                    z.writestr(entry, "1654713165.0\n64.0\n" + "\n\n".join(map(str, v)) + "\n")
            z.writestr("e4/c/BVP.csv", "x\n32.0\n1\n")
            z.writestr("e4/a/ACC.csv", "1\n2\n3\n")
    for split in (1 << 20, 90):
        got = archives.archive_samples(spark, f"{tmp_path}/*.zip", "BVP.csv", skip=2, split=split)
        assert got.rdd.getNumPartitions() >= (5 if split > 100 else 20)
        held: dict = {}
        for r in got.collect():
            held.setdefault((r["subject"], r["entry"]), []).append((r["idx"], r["value"]))
        assert all([v for _, v in sorted(held[k])] == [float(x) for x in want] and [i for i, _ in sorted(held[k])] == list(range(len(want))) for k, want in values.items())
    one = archives.archive_samples(spark, f"{tmp_path}/*.zip", "BVP.csv", skip=2, subjects=["002"])
    assert {r[0] for r in one.select("subject").distinct().collect()} == {"002"}
    starts = {(r["subject"], r["entry"]): (r["start"], r["reason"]) for r in archives.session_starts(spark, f"{tmp_path}/*.zip").collect()}
    assert starts["001", "e4/b/BVP.csv"] == (1654713165.0, None) and starts["002", "e4/c/BVP.csv"] == (None, "no start") and len(starts) == 5
    assert archives.archive_samples(spark, f"{tmp_path}/*.none", "BVP.csv").count() == 0
