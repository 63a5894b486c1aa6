"""Which filter removes what, in every order: a Gray-code walk over the subsets of the filters."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.store import cut, discard, keep, table

MEASURES = ("n", "good", "toxic")

_SPACE = r"[\x20\x09-\x0D]"


def text_failures(docs: DataFrame) -> DataFrame:
    """Adds A, B, C, D to docs (text), 1 where the text fails that filter. A null text is empty.

    The words stand in a projection of their own, so that a text is split once."""
    t = F.coalesce("text", F.lit(""))
    split = docs.withColumn("text", t).withColumn("words", F.array_remove(F.split("text", f"{_SPACE}+"), ""))
    failing = {
        "A": F.size("words") < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * F.size("words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    return split.withColumns({k: v.cast("int") for k, v in failing.items()}).drop("words")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and by the set of filters that they fail; bit i is letter i of ABCDE.

    E is a repeat: the text equals that of a smaller doc_id. Texts are read once; what is kept of each is its digest and
    bits. The least doc_id of each digest is found by partial minima, and what stands at it is joined by (digest, doc_id),
    so a text with a third of all rows is never gathered. Rows that agree in everything are counted together first."""
    judged = text_failures(docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")))
    bits = (F.col("A") + 2 * F.col("B") + 4 * F.col("C") + 8 * F.col("D")).alias("bits")
    rows = keep(judged.select("doc_id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), bits).groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n")))
    # a null doc_id has no label and meets nobody: its key is its digest's, so that such rows spread over tasks
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("none", F.col("doc_id").isNull())
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("none", F.lit(False))
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("key")).withColumns({"none": F.lit(False), "first": F.lit(True)})
    joined = keyed.join(known, ["key", "none"], "left").join(least, ["key", "none", "digest"], "left")
    mask = F.col("bits") + F.when(~F.col("none") & F.col("first").isNull(), 16).otherwise(0)
    counted = [F.sum("n").alias("n")] + [F.sum(F.col("n") * F.coalesce(m, F.lit(0))).alias(m) for m in MEASURES[1:]]
    out = cut(joined.groupBy("part", mask.alias("mask")).agg(*counted))
    discard(rows)
    return out


def states(table: np.ndarray, k: int) -> np.ndarray:
    """Survivors under every subset of k filters. table: (parts, 2**k masks, measures); the same shape comes back, by subset.

    The walk goes through the subsets in Gray-code order, so each step switches one filter. A cell's counter holds how
    many of the filters that are on it fails; it leaves the survivors when its counter rises to one and joins them again
    when it falls to none."""
    size = 1 << k
    failing = np.array([[mask >> f & 1 for mask in range(size)] for f in range(k)], bool)
    counter, out = np.zeros(size, np.int64), np.zeros_like(table)
    alive, subset = table.sum(axis=1), 0
    out[:, 0] = alive
    for step in range(1, size):
        flipped = (step & -step).bit_length() - 1
        subset ^= 1 << flipped
        on = subset >> flipped & 1
        touched = failing[flipped]
        turned = touched & (counter == (0 if on else 1))
        counter[touched] += 1 if on else -1
        moved = table[:, turned].sum(axis=1)
        alive = alive - moved if on else alive + moved
        out[:, subset] = alive
    return out


def steps(survivors: np.ndarray, cell: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """Columns of the report: for each part each order of the letters, for each order its steps."""
    k, full = len(letters), (1 << len(letters)) - 1
    orders = ["".join(p) for p in permutations(letters)]
    filters = np.array([[letters.index(c) for c in order] for order in orders])
    after = np.cumsum(1 << filters, axis=1)
    before = after - (1 << filters)
    removed = survivors[:, before] - survivors[:, after]  # parts, orders, steps, measures
    failed = np.stack([cell[:, [m for m in range(full + 1) if m >> f & 1], 0].sum(axis=1) for f in range(k)], axis=1)
    shapley = np.stack([removed[:, filters == f, 0].sum(axis=1) for f in range(k)], axis=1)
    return {
        "filter_order": np.tile(np.repeat(orders, k), len(cell)),
        "step": np.tile(np.arange(1, k + 1), len(orders) * len(cell)),
        "kept": survivors[:, after, 0].ravel(),
        "removed": removed[..., 0].ravel(),
        "redundant": (failed[:, filters] - removed[..., 0]).ravel(),
        "unique_fails": cell[:, 1 << filters, 0].ravel(),
        "good_lost": removed[..., 1].ravel(),
        "toxic_lost": removed[..., 2].ravel(),
        "shapley": shapley[:, filters].ravel(),
    }


def audit(cell_rows: DataFrame, letters: str) -> DataFrame:
    """The report of cells (part, mask, n, good, toxic): a row per part, order of the letters and step, zeros included.

    A part has at most 2**k cells, whatever its documents are; parts are walked together, a batch of them at a time."""
    k = len(letters)
    size = 1 << k
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts)

    def walk(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                cell = np.zeros((piece.num_rows, size, len(MEASURES)), np.int64)
                for i, found in enumerate(piece.column("cells").to_pylist()):
                    for c in found:
                        cell[i, c["mask"]] = [c[m] for m in MEASURES]
                out = steps(states(cell, k), cell, letters)
                each = len(out["step"]) // piece.num_rows
                part = piece.column("part").take(pa.array(np.repeat(np.arange(piece.num_rows), each)))
                yield pa.RecordBatch.from_arrays([part, pa.array(out["filter_order"].tolist(), pa.string()), pa.array(out["step"], pa.int32()), *[pa.array(out[c], pa.int64()) for c in counts]], ["part", "filter_order", "step", *counts])

    return cell_rows.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells")).mapInArrow(walk, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of docs (doc_id, text, source).

    Null or empty texts fail A only, and E where a smaller doc_id has an empty one. A null source is the empty string's
    part. A row with a null doc_id is never a repeat, makes nobody one and has no label; rows that share doc_id and text
    are no repeats of each other. A document is good or toxic if any of its labels says so. An empty table gives no rows;
    other columns play no part."""
    return audit(cells(docs, labels), "ABCDE")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTERS = "(VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E'))"
ORACLE = rf"""
WITH word AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1
), label AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1
), doc AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(word.doc_id > first, false)::int AS mask
  FROM word JOIN least USING (t) LEFT JOIN label USING (doc_id)
), cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM doc GROUP BY ALL
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM {_LETTERS} a(i, l), {_LETTERS} b(i, l), {_LETTERS} c(i, l), {_LETTERS} d(i, l), {_LETTERS} e(i, l)
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), step AS (
  SELECT filter_order, s AS step, filter_order[s] AS letter, 1 << (ascii(filter_order[s]) - 65) AS bit,
    list_sum(list_transform(range(1, s), lambda j: 1 << (ascii(filter_order[j]) - 65))) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
), out AS (
  SELECT part, filter_order, step, letter,
    sum(n) FILTER (WHERE mask & (coalesce(before, 0) | bit) = 0) AS kept,
    sum(n) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (WHERE mask & coalesce(before, 0) > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS toxic_lost
  FROM cell, step GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed,
  coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost,
  coalesce(toxic_lost, 0)::bigint AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::bigint AS shapley
FROM out
"""
