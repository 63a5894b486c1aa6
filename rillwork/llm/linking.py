"""Verified near-duplicate links from MinHash bands, without expanding buckets into all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.components import connected_components
from rillwork.llm.store import BROADCAST_IDS, cut, semi
from rillwork.llm.text import U64, blocks, distinct, jaccard_parts, per_batch


def _sets(batch: pa.RecordBatch, key: str, name: str) -> list[np.ndarray]:
    """Shingle sets of a column of texts; one that repeats from row to row is made once."""
    ids = np.asarray(batch.column(key))
    new = np.append(True, ids[1:] != ids[:-1])
    some = batch.select([name]).filter(pa.array(new))
    made = [x for _, _, texts in blocks(some, name) for x in distinct(*texts.shingles())]
    return [made[k] for k in np.cumsum(new) - 1]


def _same(percent: int):
    """For mapInArrow over (a, b, ta, tb): keeps the pairs whose shingle sets are alike enough."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                both = (jaccard_parts(a, b) for a, b in zip(_sets(batch, "a", "ta"), _sets(batch, "b", "tb"), strict=True))
                yield batch.select(["a", "b"]).filter(pa.array([100 * x >= percent * y and y > 0 for x, y in both], pa.bool_()))

    return run


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = _sets(batch, "id", "text")
    at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])


#: 64-bit words of a set's parities: bit h of them is the parity of the elements hashed to h, so two sets differ in at
#: least as many elements as their parities in bits. That bounds the intersection from above, exactly.
PARITIES = 32


def _parities(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for x in _sets(batch, "id", "text"):
        odd = np.bincount((x >> U64(20)).astype(np.int64) & (PARITIES * 64 - 1), minlength=PARITIES * 64) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    words = np.stack(out)
    return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(words[:, i]) for i in range(PARITIES))], ["id", *(f"p{i}" for i in range(PARITIES))])


_NAMES = [f"p{i}" for i in range(PARITIES)]


def _odd(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(per_batch(_parities), "id long, " + ", ".join(f"{p} long" for p in _NAMES))


def _fits(percent: int) -> str:
    """SQL for x and y of different labels that may be alike enough by their sizes n and parities."""
    most = "(x.n + y.n - (" + " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in _NAMES) + ")) div 2"
    return f"x.label <> y.label and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and 100 * ({most}) >= {percent} * (x.n + y.n - {most})"


def _in_buckets(named: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b), b < a: pairs of one bucket (key) with different labels that may be alike enough. Every member outside the
    bucket's largest component is held against all members of others; those are split over tasks where they are many."""
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.ceil((F.sum("size") - F.max("size")) / SPLIT).alias("pieces"))
    several = named.join(main, "key").join(_odd(texts), "id")
    one = several.where("label <> main").withColumn("piece", F.expr("pmod(xxhash64(id), pieces)")).alias("x")
    other = several.withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)"))).alias("y")
    pairs = one.join(other, F.expr(f"x.key = y.key and x.piece = y.piece and {_fits(percent)}"))
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def _alike(items: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b), b < a: pairs of items (id, label; materialised) with different labels that may be alike enough, found exactly.

    Two sets that are share one of the rarest of their shingles: of n in order of frequency and value, one of the first
    n - ceil(n * percent / 100) + 1. A join by these holds no pair together for a common phrase, and what differs in
    copies with edits is rare; the join itself rejects what can't be alike by sizes and parities. A shingle that many
    sets still have is split over tasks."""
    each = texts.mapInArrow(per_batch(_listed), "id long, shingles array<long>").join(items, "id")
    rows = cut(each.select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("h")))
    ranked = rows.join(rows.groupBy("h").agg(F.count("*").alias("times")), "h")
    place = F.row_number().over(Window.partitionBy("id").orderBy("times", "h"))
    first = cut(ranked.withColumn("place", place).where(F.expr(f"place <= n - ceil(n * {percent} / 100.0) + 1 and times > 1")).select("id", "label", "n", "h"))
    pieces = first.groupBy("h").agg(F.ceil(F.count("*") / SPLIT).alias("pieces"), F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("h", "pieces")
    dealt = first.join(pieces, "h").join(_odd(texts), "id")
    one = dealt.withColumn("piece", F.expr("pmod(xxhash64(id), pieces)")).alias("x")
    other = dealt.withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)"))).alias("y")
    fits = F.expr(f"x.h = y.h and x.piece = y.piece and x.id > y.id and {_fits(percent)}")
    return one.join(other, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


#: Pairs of one member, and sets with one shingle, that a task takes together; more are split.
SPLIT = 500


def verified(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """Those (a, b) of a materialised list whose whole texts' shingle sets have 100 * both >= percent * either.

    The pairs of a b with many are split over several copies of its text."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    need = semi(texts, ids, "id", ids.count()).groupBy("id").agg(F.first("text").alias("text"))
    hot = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / SPLIT).alias("pieces")).where("pieces > 1"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.expr("coalesce(pmod(xxhash64(a), pieces), 0)").alias("piece"))
    hubs = need.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(hot, "b", "left").select("b", "tb", F.explode(F.expr("sequence(0L, coalesce(pieces, 1) - 1)")).alias("piece"))
    full = dealt.join(need.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(hubs, ["b", "piece"])
    return full.select("a", "b", "ta", "tb").mapInArrow(_same(percent), "a long, b long")


def bucket_members(items: DataFrame) -> DataFrame:
    """(key, id, n, hub, nh) of items (id long, n long, keys array<long>; one row per id): the members of every bucket of
    several, and its least id, the hub, with its size."""
    rows = items.select("id", "n", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.min_by("n", "id").alias("nh")).where("hub <> last").drop("last")
    return rows.join(hubs, "key").select("key", "id", "n", "hub", "nh")


def near_components(members: DataFrame, texts: DataFrame, percent: int = 75, rare: bool = False) -> DataFrame:
    """(id, label) of the items that are linked with another one; label is the least id reachable.

    members: bucket_members(), materialised: key, id, n (set size), hub, nh (its set size); a bucket's hubs must be
    members of it that lead to one another or to one. texts: id, text; rows with equal ids have equal texts.

    1. A bucket's members are compared with its hub only (a star), so a bucket of n costs n comparisons.
    2. Components of those links are found. In buckets that still hold several components members of different ones
       are held against each other, and what can't be ruled out is verified. After that each two members of a bucket
       are in one component or known to be unlike, so no link that the bands suggest is lost. The pairs come from the
       buckets themselves, or with rare, for small sets whose buckets common phrases make, from an exact join by the
       sets' rarest shingles.
    """
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    stars = cut(members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("nh").alias("nb")).distinct().where(fits).select("a", "b"))
    links = cut(verified(stars, texts, percent))
    labels = cut(connected_components(links))

    named = members.select("key", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("key")
    several = cut(named.join(mixed, "key"))
    ids = cut(several.select("id", "label").distinct())
    n = ids.count()
    if not n:
        return labels.withColumnRenamed("node", "id")
    need = semi(texts, ids.select("id"), "id", n).groupBy("id").agg(F.first("text").alias("text"))
    pairs = _alike(ids, need, percent) if rare else _in_buckets(several, need, percent)
    rest = cut(pairs.join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = cut(verified(rest, texts, percent))
        if not more.isEmpty():
            labels = cut(connected_components(links.unionByName(more)))
    return labels.withColumnRenamed("node", "id")
