"""Pairing readings with recordings by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.operators.readings import keep_first


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bin_seconds: int) -> DataFrame:
    """Points within spans of the same key, both ends included.

    A span is entered under every time bin that it touches and a point under its own, so the join is an equi-join on
    (key, bin) with the bounds as a residual: it spreads one busy key over many tasks, and no pair meets twice. Choose
    bins near the usual length of a span."""
    width = bin_seconds * 1_000_000
    bins = F.sequence(F.floor(micros(start) / width), F.floor(micros(end) / width))
    left = points.withColumn("_bin", F.floor(micros(at) / width))
    right = spans.withColumn("_bin", F.explode(bins))
    return left.join(right, [key, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def catalogue(samples: DataFrame) -> DataFrame:
    """(subject, device, session_id, t_start, t_end, n) of narrow samples (subject, device, session_id, ts)."""
    return samples.groupBy("subject", "device", "session_id").agg(F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.count("*").alias("n"))


def first_covering(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of all sessions that cover a reading, the first by session_id."""
    return keep_first(pairs, keys, ["session_id"])


def both_modalities(readings: DataFrame, first: DataFrame, second: DataFrame, bin_seconds: int) -> DataFrame:
    """Readings with a session of either kind: subject, ts, glucose, first_session, second_session. All sessions of the
    first kind count, and the first covering one of the second; then one row per reading is kept."""
    a = range_join(readings, first, "subject", "ts", "t_start", "t_end", bin_seconds).select("subject", "ts", "glucose", F.col("session_id").alias("first_session"))
    b = first_covering(range_join(readings, second, "subject", "ts", "t_start", "t_end", bin_seconds), ["subject", "ts"]).select("subject", "ts", F.col("session_id").alias("second_session"))
    return keep_first(a.join(b, ["subject", "ts"]), ["subject", "ts"], ["first_session"])


def chunked(samples: DataFrame, size: int) -> DataFrame:
    """(session_id, chunk_no, first_idx, values) from narrow samples (session_id, idx, value): `size` samples a row, in
    order, so that later joins move whole chunks and not single samples."""
    put = samples.withColumn("chunk_no", F.floor(F.col("idx") / size))
    rows = put.groupBy("session_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("s"))
    return rows.select("session_id", "chunk_no", (F.col("chunk_no") * size).alias("first_idx"), F.col("s.value").alias("values"))


def window_before(readings: DataFrame, chunks: DataFrame, n: int, size: int) -> DataFrame:
    """The n samples before each reading (session_id, end_idx, ...): [end_idx - n, end_idx), if all of them exist.

    Joins the few chunks that a window touches by (session_id, chunk_no), then cuts the window out of them."""
    first, last = F.floor((F.col("end_idx") - n) / size), F.floor((F.col("end_idx") - 1) / size)
    wanted = readings.where(F.col("end_idx") >= n).withColumn("chunk_no", F.explode(F.sequence(first, last)))
    met = wanted.join(chunks, ["session_id", "chunk_no"])
    keys = [c for c in readings.columns]
    whole = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first_idx", "values"))).alias("c"))
    flat = whole.withColumn("start", F.col("c")[0]["first_idx"]).withColumn("all", F.flatten("c.values"))
    cut = flat.withColumn("window", F.slice("all", (F.col("end_idx") - n - F.col("start") + 1).cast("int"), n))
    return cut.where(F.size("window") == n).select(*keys, "window")


def clock_scores(utc_starts: DataFrame, local_starts: DataFrame, zones: list[str], tolerance_s: int) -> DataFrame:
    """(subject, zone, matches): how many starts of a UTC clock (subject, t) have a start of a local clock (subject, t)
    less than tolerance_s away, under each zone. Zones follow daylight saving by the instant.

    The near test is an equi-join on bins of the tolerance's width, each local start entered under three of them."""
    each = utc_starts.withColumn("zone", F.explode(F.array(*map(F.lit, zones)))).withColumn("t", F.from_utc_timestamp("t", F.col("zone")).cast("timestamp_ntz"))
    width = tolerance_s * 1_000_000
    left = each.withColumn("bin", F.floor(micros("t") / width))
    right = local_starts.select(F.col("subject").alias("s"), F.col("t").alias("u"), F.explode(F.expr(f"array({', '.join(f'floor(unix_micros(cast(t as timestamp)) / {width}) + {d}' for d in (-1, 0, 1))})")).alias("b"))
    near = (F.col("subject") == F.col("s")) & (F.col("bin") == F.col("b")) & (F.abs(micros("t") - micros("u")) < width)
    hit = left.join(right, near, "left_semi").groupBy("subject", "zone").agg(F.count("*").alias("matches"))
    all_zones = utc_starts.select("subject").distinct().withColumn("zone", F.explode(F.array(*map(F.lit, zones))))
    return all_zones.join(hit, ["subject", "zone"], "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))


def clock_winner(scores: DataFrame, zones: list[str], least: int = 5, margin: int = 2) -> DataFrame:
    """(subject, zone, best, second, decided): the zone with most matches, earlier in the list on a tie. It is decided
    with at least `least` matches and `margin` times those of the next zone (taken as 1 at least); else zone is null."""
    order = Window.partitionBy("subject").orderBy(F.desc("matches"), F.array_position(F.array(*map(F.lit, zones)), F.col("zone")))
    ranked = scores.withColumn("r", F.row_number().over(order)).where("r <= 2")
    two = ranked.groupBy("subject").agg(F.max(F.when(F.col("r") == 1, F.col("zone"))).alias("zone"), F.max(F.when(F.col("r") == 1, F.col("matches"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("matches"))), F.lit(0).cast("long")).alias("second"))
    decided = (F.col("best") >= least) & (F.col("best") >= margin * F.greatest("second", F.lit(1)))
    return two.select("subject", F.when(decided, F.col("zone")).alias("zone"), "best", "second", decided.alias("decided"))
