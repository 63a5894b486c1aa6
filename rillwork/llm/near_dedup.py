"""Near-duplicate documents by circulant MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.linking import bucket_members, near_components
from rillwork.llm.store import cut, discard, fresh, keep, table
from rillwork.llm.text import band_keys, blocks, circulant, distinct, per_batch

#: At a similarity of 0.75 a pair shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6.
BANDS, ROWS = 32, 4


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, id, n, keys) per row of (doc_id, text): id is a 64-bit hash of the text, n the size of its shingle set,
    keys its band keys (none if the set is empty)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys = [], []
        for _, _, texts in blocks(batch):
            hashes, at = texts.shingles()
            sizes += [len(x) for x in distinct(hashes, at)]
            keys.append(band_keys(circulant(hashes, at, bands * rows), bands, rows))
        n = np.array(sizes, np.int64)
        flat = np.concatenate(keys)[n > 0].ravel()
        at = np.concatenate(([0], np.cumsum((n > 0) * bands))).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "id", "n", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("id")).mapInArrow(per_batch(run), "doc_id long, id long, n long, keys array<long>")


def _linked(docs: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_id, n, id, component_id, keeper) per row of docs: text_id is the text's hash, id the same where the text
    has shingles, keeper the id that stands for its component: of the least doc_id, or of none if all are null."""
    signed = cut(signatures(docs, bands, rows))
    classes = cut(signed.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    texts = docs.select(F.xxhash64("text").alias("id"), "text").where("text is not null")
    members = keep(bucket_members(classes.select("id", "n", "keys")))
    linked = near_components(members, texts, percent)
    discard(members)
    named = classes.select("id", "first_doc").join(linked, "id", "left").select("id", "first_doc", F.coalesce("label", "id").alias("label"))
    keeper = F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "id"))["id"]
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"), keeper.alias("keeper"))
    of_class = named.join(least, "label").select("id", "component_id", "keeper")
    return signed.select("doc_id", F.col("id").alias("text_id"), "n", F.when(F.col("n") > 0, F.col("id")).alias("id")).join(of_class, "id", "left")


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are left alone).

    Rows of equal text form a class by a 64-bit hash of the text, so thousands of copies cost one; classes are linked
    through bands and exact Jaccard similarity. component_id is the least doc_id reachable. A text that is null or has
    no words has 0 shingles and is linked with nothing. A row that repeats gives its result again; an empty table gives
    no rows; a null doc_id gets the component's id, or null if nothing else is in it.
    """
    out = _linked(docs, percent, bands, rows)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that stand for their component stay, as do those without words.

    A row is known by doc_id and text, so rows of one doc_id with other texts don't stand for each other. Of rows with a null
    doc_id one stays where their component has no other document; equal ones of them count as copies, not as one row."""
    name, of_id, of_text = fresh(docs, "text_id"), fresh(docs, "id_of"), fresh(docs, "text_of")
    linked = _linked(docs.select("doc_id", "text"), 75, BANDS, ROWS)
    stay = linked.where("id is null or (doc_id <=> component_id and id = keeper)").groupBy("doc_id", "text_id").agg(F.max(F.col("id").isNotNull()).alias("words"))
    bare = cut(stay.where("doc_id is null and words").select(F.col("text_id").alias(name)))
    hashed = docs.withColumn(name, F.xxhash64("text"))
    listed = stay.where("doc_id is not null or not words").select(F.col("doc_id").alias(of_id), F.col("text_id").alias(of_text))
    rest = hashed.join(listed, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(name) == F.col(of_text)), "left_semi")
    one = hashed.where("doc_id is null").join(bare, name, "left_semi").dropDuplicates([name])
    return rest.select(docs.columns).unionByName(one.select(docs.columns))


#: The same links from all pairs that share a shingle, and components from reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT DISTINCT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON m.a = doc_id
"""
