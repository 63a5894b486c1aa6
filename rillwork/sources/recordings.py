"""Reading exports of sensors and archives into tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.zones import MGDL


def _by_prefix(df: DataFrame, prefix: str) -> F.Column:
    """The column whose header begins with prefix; exports differ in what follows."""
    found = [c for c in df.columns if c.strip().startswith(prefix)]
    if not found:
        raise ValueError(f"no column begins with {prefix!r}: {df.columns}")
    return F.col(f"`{found[0]}`")


def read_cgm(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """(subject, timestamp, glucose) of a glucose export in mg/dL; other event types and values such as Low are left out."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.where(F.col("`Event Type`") == "EGV").select(F.lit(subject).alias("subject"), F.try_to_timestamp(_by_prefix(raw, "Timestamp")).cast("timestamp_ntz").alias("timestamp"), (_by_prefix(raw, "Glucose Value").try_cast("double") / MGDL).alias("glucose"))
    return rows.na.drop()


def read_glucose(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """(subject, timestamp, glucose, type) of an export with date and time apart, already in mmol/L."""
    raw = spark.read.option("header", True).csv(path)
    stamp = F.try_to_timestamp(F.concat_ws(" ", "date", "time")).cast("timestamp_ntz")
    return raw.select(F.lpad(F.lit(subject), 3, "0").alias("subject"), stamp.alias("timestamp"), F.col("glucose").try_cast("double").alias("glucose"), "type").na.drop(subset=["glucose"])


def read_ecg(spark: SparkSession, glob: str, fs: float | None = 250.0) -> DataFrame:
    """(session_id, t0, fs, idx, value): one file per session, day before month. With fs None the rate comes from the
    first and last time of each file. Samples are numbered by time, so split files keep their order."""
    raw = spark.read.option("header", True).schema("Time string, EcgWaveform double").csv(glob)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("session_id"), F.try_to_timestamp("Time", F.lit("dd/MM/yyyy HH:mm:ss.SSS")).alias("t"), F.col("EcgWaveform").alias("value")).where("t is not null")
    about = rows.groupBy("session_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    seconds = (F.unix_micros("t1") - F.unix_micros("t0")) / 1e6
    about = about.withColumn("fs", F.lit(fs) if fs else (F.col("n") - 1) / F.nullif(seconds, F.lit(0.0)))
    at = F.bround((F.unix_micros("t") - F.unix_micros("t0")) / 1e6 * F.col("fs")).cast("long")
    return rows.join(about, "session_id").select("session_id", F.col("t0").cast("timestamp_ntz").alias("t0"), "fs", at.alias("idx"), "value")


def read_ppg(spark: SparkSession, glob: str, zone: str, rate: float = 64.0) -> tuple[DataFrame, DataFrame]:
    """Good and rejected sessions of files with the start in epoch seconds, the rate and then one value a line.

    Good: (session_id, t0, values), t0 local to the zone. Rejected: (session_id, reason)."""
    raw = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("session_id"), F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    named = raw.select("session_id", F.get("lines", F.lit(0)).try_cast("double").alias("start"), F.get("lines", F.lit(1)).try_cast("double").alias("fs"), "lines")
    reason = F.when(F.col("start").isNull(), "no start").when(F.col("fs").isNull() | (F.abs(F.col("fs") - rate) > 1e-6), "wrong rate")
    judged = named.withColumn("reason", reason)
    values = F.transform(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), lambda x: x.try_cast("double"))
    good = judged.where("reason is null").select("session_id", F.from_utc_timestamp(F.timestamp_seconds("start"), zone).cast("timestamp_ntz").alias("t0"), values.alias("values"))
    return good, judged.where("reason is not null").select("session_id", "reason")


def session_starts_from_names(files: DataFrame) -> DataFrame:
    """(session_id, t_start) of (path): folders named YYYY_MM_DD-HH_MM_SS, each once."""
    name = F.regexp_extract("path", r"(\d{4}_\d{2}_\d{2}-\d{2}_\d{2}_\d{2})/", 1)
    return files.select(name.alias("session_id")).where("session_id <> ''").distinct().withColumn("t_start", F.try_to_timestamp("session_id", F.lit("yyyy_MM_dd-HH_mm_ss")).cast("timestamp_ntz")).where("t_start is not null")


def unzip(spark: SparkSession, glob: str, suffix: str = "") -> DataFrame:
    """(archive, entry, content) of the entries of zip archives; one archive is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted({n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")}):
                        yield pd.DataFrame([(path, name, z.read(name))], columns=["archive", "entry", "content"])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "archive string, entry string, content binary")


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that no manifest row names yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def manifest(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The units that write_results() has completed below path; none if nothing was written there yet."""
    shape = ", ".join(f"{k} string" for k in by)
    try:
        return spark.read.schema(shape).parquet(f"{path}/manifest")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def read_features(spark: SparkSession, path: str, subjects: list[str] | None = None, width: int = 3) -> DataFrame:
    """A feature table whose subjects are strings of at least `width` digits, also where Spark or an export took them for
    numbers; with subjects, those only."""
    name = F.col("subject").cast("string")
    rows = spark.read.parquet(path).withColumn("subject", F.lpad(name, F.greatest(F.length(name), F.lit(width)), F.lit("0")))
    return rows if subjects is None else rows.where(F.col("subject").isin(subjects))


def read_results(spark: SparkSession, path: str, name: str, by: list[str]) -> DataFrame:
    """Rows of a results table whose units are complete; a unit that is half written or not there gives none."""
    done = manifest(spark, path, by).distinct()
    shape = T.StructType([T.StructField(f.name, T.StringType()) if f.name in by else f for f in spark.read.parquet(f"{path}/{name}").schema])
    return spark.read.schema(shape).parquet(f"{path}/{name}").join(done, by, "left_semi")


def write_units(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has; a unit is there whole or not at all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_results(tables: dict[str, DataFrame], path: str, by: list[str], unit: dict[str, str]) -> None:
    """Writes a unit's tables, then its manifest row, so a row in the manifest means that all tables are complete."""
    for name, df in tables.items():
        write_units(df, f"{path}/{name}", by)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([tuple(unit[k] for k in by)], ", ".join(f"{k} string" for k in by)).write.mode("append").parquet(f"{path}/manifest")


def sweep(spark: SparkSession, configs: list[dict[str, str]], path: str, run: Callable[[dict[str, str]], dict[str, DataFrame]]) -> list[dict[str, str]]:
    """Runs the configurations that the manifest below path doesn't name and writes each one's tables; returns those run.

    All configurations have the same keys. run gives a configuration's tables, which get its values as columns; one that
    fails leaves no manifest row, so the next sweep takes it up again."""
    by, took = list(configs[0]) if configs else [], []
    done = {tuple(r) for r in manifest(spark, path, by).select(*by).distinct().collect()} if by else set()
    for config in configs:
        if tuple(config[k] for k in by) not in done:
            named = {name: df.withColumns({k: F.lit(v) for k, v in config.items()}) for name, df in run(config).items()}
            write_results(named, path, by, config)
            took.append(config)
    return took
