"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.store import cut, fresh, keep, table
from rillwork.llm.text import U32, U64, blocks, distinct, per_batch, permute

#: Coordinates of a signature. A window holds at most 4 times the shingles of an item of its partition, so at a
#: containment of 0.75 their Jaccard similarity is 0.17 or more, and no coordinate agrees with probability 1e-5.
COORDINATES = 64
#: Items, and shingles of them, that a task holds at once; more are taken block by block.
ITEMS, SHINGLES = 20_000, 4_000_000
PERCENT = 75


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, n, shingles array<long>): the distinct shingles of each item that has any."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x for _, _, texts in blocks(batch) for x in distinct(*texts.shingles())]
        n = np.array([len(x) for x in sets], np.int64)
        at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        flat = np.concatenate([*sets, np.zeros(0, U64)]).astype(U64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["item_id", "n", "shingles"])

    return items.select("item_id", "text").mapInArrow(per_batch(run), "item_id long, n long, shingles array<long>").where("n > 0")


class _Index:
    """Items by size partition: partition p has those of 2**p to 2**(p + 1) - 1 shingles, with their signatures."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], coordinates: int):
        self.coordinates, self.ids, self.sets, self.parts = coordinates, [r[0] for r in rows], [r[1] for r in rows], {}
        for p in sorted({len(s).bit_length() - 1 for s in self.sets}):
            mine = [i for i, s in enumerate(self.sets) if len(s).bit_length() - 1 == p]
            keys = np.stack([_coordinates(self.sets[i], coordinates) for i in mine]) | (np.arange(coordinates, dtype=U64) << U64(32))
            order = np.argsort(keys.ravel(), kind="stable")
            near = np.zeros(1 << 20, bool)
            near[keys.ravel() & U64((1 << 20) - 1)] = True
            self.parts[p] = keys.ravel()[order], np.repeat(mine, coordinates)[order], near


def _coordinates(hashes: np.ndarray, k: int) -> np.ndarray:
    x = permute((hashes >> U64(32)).astype(U32), 0x1B56C4E9)
    return np.array([permute(x + U32(j), 0x3C6EF372).min() for j in range(k)], U64)


def _candidates(hashes: np.ndarray, at: np.ndarray, index: _Index) -> set[tuple[int, int]]:
    """(text, item) where a window of the text and an item agree in a coordinate.

    For partition p a text is cut into blocks of 2**(p + 1) consecutive shingles; a window is two blocks in a row, so
    any run of 2**(p + 1) shingles lies in one window. The minima of larger blocks are those of smaller ones joined."""
    found: set[tuple[int, int]] = set()
    n = np.diff(at)
    if not index.parts or not len(hashes):
        return found
    low, high = min(index.parts), max(index.parts)
    size = 2 << low
    per = -(-n // size)
    start = np.repeat(at[:-1], per) + size * (np.arange(per.sum()) - np.repeat(np.concatenate(([0], np.cumsum(per)[:-1])), per))
    x = permute((hashes >> U64(32)).astype(U32), 0x1B56C4E9)
    step = max(1, (1 << 15) // size)
    minima = np.empty((index.coordinates, len(start)), U32)
    for lo in range(0, len(start), step):
        hi = min(lo + step, len(start))
        a, b = start[lo], start[hi] if hi < len(start) else len(x)
        piece, begin = x[a:b], start[lo:hi] - a
        for j in range(index.coordinates):
            minima[j, lo:hi] = np.minimum.reduceat(permute(piece + U32(j), 0x3C6EF372), begin)
    tags = np.arange(index.coordinates, dtype=U64)[:, None] << U64(32)
    for p in range(low, high + 1):
        text = np.repeat(np.arange(len(n)), per)
        if p in index.parts:
            keys, items, near = index.parts[p]
            window = minima.copy()
            same = np.flatnonzero(text[1:] == text[:-1])
            window[:, same] = np.minimum(minima[:, same], minima[:, same + 1])
            hit = np.nonzero(near[window & U32((1 << 20) - 1)])
            if len(hit[0]):
                probe = window[hit].astype(U64) | tags[hit[0], 0]
                left, right = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
                for k in np.flatnonzero(right > left):
                    found.update((int(text[hit[1][k]]), int(i)) for i in items[left[k] : right[k]])
        if p < high:  # blocks of twice the size
            first = np.concatenate(([0], np.cumsum(per)[:-1]))
            within = np.arange(len(text)) - first[text]
            begins = np.flatnonzero(within % 2 == 0)
            minima = np.minimum.reduceat(minima, begins, axis=1) if len(begins) else minima
            per = -(-per // 2)
    return found


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, coordinates: int = COORDINATES, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): documents that hold an item.

    docs: doc_id, text; items: item_id, text; other columns are left alone. n_item is the size of the item's set of
    five-word shingles (an item of fewer words is one shingle), n_shared how many of them are among the document's;
    a pair is given if 100 * n_shared >= percent * n_item. Items are partitioned by size; against each partition a
    document of any length is searched window by window with MinHash signatures, and each pair found is checked on
    the whole sets. Items are taken in blocks of bounded size, in items and in shingles (but for one item that is longer
    by itself), each broadcast and held against all documents, so the benchmark may grow without bound. Nulls and texts without words match nothing; empty tables give no rows; an item
    or a document that repeats gives its rows again.
    """
    spark = docs.sparkSession
    sets = keep(item_sets(items))
    size = sets.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    parts = max(1, -(-size["items"] // block), -(-size["shingles"] // SHINGLES))
    blocks_of = [sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(parts)) == i) for i in range(parts)]
    out = None
    for part in blocks_of:
        rows = [(r["item_id"], np.array(r["shingles"], np.int64).view(U64)) for r in part.toLocalIterator()]
        held = spark.sparkContext.broadcast(pickle.dumps(_Index(rows, coordinates)))

        def run(batches, held=held):
            index = pickle.loads(held.value)

            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, got = batch.column("doc_id").to_pylist(), []
                for i, _, texts in blocks(batch):
                    hashes, at = texts.shingles()
                    sets_of: dict[int, np.ndarray] = {}
                    for text, item in sorted(_candidates(hashes, at, index)):
                        if text not in sets_of:
                            sets_of = {text: np.unique(hashes[at[text] : at[text + 1]])}
                        want = index.sets[item]
                        shared = len(np.intersect1d(want, sets_of[text], assume_unique=True))
                        if 100 * shared >= percent * len(want):
                            got.append((ids[i + text], index.ids[item], len(want), shared, shared / len(want)))
                cols = list(zip(*got, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

            yield from per_batch(one)(batches)

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long, containment double")
        out = found if out is None else out.unionByName(found)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go. They are known by their texts' hashes, whatever their doc_id."""
    name = fresh(docs, "text_id")
    hashed = docs.withColumn(name, F.xxhash64("text"))
    hit = cut(contained(hashed.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct())
    return hashed.join(hit, name, "left_anti").select(docs.columns)


ORACLE = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT k, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT k, id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT k, id, unnest(sh) AS h FROM s),
n AS (SELECT id, len(sh) AS n FROM s WHERE k = 'i')
SELECT d.id AS doc_id, i.id AS item_id, CAST(n.n AS BIGINT) AS n_item, count(*) AS n_shared, count(*) / n.n AS containment
FROM e d JOIN e i ON d.k = 'd' AND i.k = 'i' AND d.h = i.h JOIN n ON n.id = i.id GROUP BY d.id, i.id, n.n HAVING 100 * count(*) >= 75 * n.n
"""
