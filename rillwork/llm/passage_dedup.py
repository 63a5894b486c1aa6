"""Repeated passages inside documents by paragraph MinHash banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm.linking import near_components
from rillwork.llm.store import discard, fresh, keep, table
from rillwork.llm.text import U64, Texts, band_keys, blocks, circulant, mix, per_batch

#: A paragraph begins at a line of LEAST_WORDS or more, behind one, or where the hash of two words is the least among its
#: RADIUS neighbours on both sides.
RADIUS = 7
#: No paragraph has fewer words unless its text has.
LEAST_WORDS = 6
#: Runs of repeated paragraphs of fewer words are not reported: a passage of fifty words loses up to a dozen at each end,
#: where its paragraphs reach into what is around it. Whole lines that repeat lose nothing, so they count from WHOLE_LINES
#: words on: a repeated line alone is no passage.
RUN_WORDS, WHOLE_LINES = 15, 26
#: Equal paragraphs share every band; at a similarity of 0.75 two share none with probability 0.13 percent, at 0.9 0.0002
#: percent. A single coordinate a band would miss less, but then every common phrase makes a bucket.
BANDS, ROWS = 8, 2
#: Words that may lie between two repeated paragraphs of one passage.
GAP = 8
#: Bits of the filter that thins the scan for candidates' texts; its size never changes, its misses cost time only.
FILTER_BITS = 27


def _paragraphs(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last word of each paragraph of a block of texts, in order.

    Lines of fewer than LEAST_WORDS words make no cut between them: they are one stretch, which goes to the line behind
    it (or before it, at the end of a text) if it is that short itself. Content cuts nearer than LEAST_WORDS words to
    another cut are left out. All cuts depend on nearby words and lines only, so a passage is cut alike in every text but
    near its ends."""
    n = len(t.word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))
    lines = np.concatenate(([0], np.cumsum(t.data == 10)))
    cut_here = np.ones(n, bool)
    cut_here[1:] = (text[1:] != text[:-1]) | (lines[t.start[1:]] != lines[t.end[:-1]])
    pair = t.word.copy()
    pair[1:] = mix(t.word[:-1] * U64(0x9E3779B97F4A7C15) + t.word[1:])
    least = np.ones(n, bool)
    for j in range(1, min(RADIUS, n - 1) + 1):
        apart = text[j:] != text[:-j]
        least[j:] &= apart | (pair[j:] < pair[:-j])
        least[:-j] &= apart | (pair[:-j] <= pair[j:])
    line = np.flatnonzero(cut_here)
    long = np.diff(line, append=n) >= LEAST_WORDS
    new = np.ones(len(line), bool)
    new[1:] = long[1:] | long[:-1] | (text[line[1:]] != text[line[:-1]])
    stretch = line[new]
    short, begins = np.diff(stretch, append=n) < LEAST_WORDS, np.append(np.ones(1, bool), text[stretch[1:]] != text[stretch[:-1]])
    joined = np.append(False, short[:-1]) | (short & np.append(begins[1:], True))
    forced = np.append(stretch[begins | ~joined], n)
    inner = np.flatnonzero(least)
    at = np.searchsorted(forced, inner, "right")
    inner = inner[(inner - forced[at - 1] >= LEAST_WORDS) & (forced[at] - inner >= LEAST_WORDS)]
    first = np.union1d(forced[:-1], inner)
    return first, np.append(first[1:], n)


def _compared(t: Texts):
    """Paragraphs that are compared: (first, last, text, id, shingles, at). id is a hash of the shingles, which are in
    order, those of paragraph i from at[i] on."""
    first, last = _paragraphs(t)
    text = np.searchsorted(t.at, first, "right") - 1
    long = last - first >= LEAST_WORDS
    first, last, text = first[long], last[long], text[long]
    if not len(first):
        return first, last, text, np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(1, np.int64)
    n = len(t.word)
    h = np.zeros(max(n - 4, 0), U64)
    for j in range(5):
        h *= U64(0xD6E8FEB86659FD93)
        h += t.word[j : n - 4 + j]
    h = mix(h)
    counts = last - first - 4
    at = np.concatenate(([0], np.cumsum(counts)))
    inside = h[np.repeat(first - at[:-1], counts) + np.arange(at[-1])]
    place = np.arange(at[-1]) - np.repeat(at[:-1], counts)
    same = mix(np.add.reduceat(mix(inside + (place.astype(U64) << U64(1))), at[:-1]) + counts.astype(U64))
    return first, last, text, same.view(np.int64), inside, at


def _characters(t: Texts, first: np.ndarray, last: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where paragraphs begin and end in their texts, in characters."""
    points = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
    zero = points[t.offsets[text]]
    return points[t.start[first]] - zero, points[t.end[last - 1]] - zero


def _edges(t: Texts, first: np.ndarray, last: np.ndarray, text: np.ndarray) -> np.ndarray:
    """1 for paragraphs that begin a line of their text, plus 2 for those that end one."""
    lines = np.concatenate(([0], np.cumsum(t.data == 10)))
    begins = (first == t.at[text]) | (lines[t.start[first]] != lines[t.end[np.maximum(first - 1, 0)]])
    ends = (last == t.at[text + 1]) | (lines[t.end[last - 1]] != lines[t.start[np.minimum(last, len(t.start) - 1)]])
    return begins + 2 * ends


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, w0, w1, c0, c1, edges, id): every paragraph that is compared, in words and characters from w0 and c0
    up to w1 and c1, with a hash of its shingles; edges is 1 if it begins a line, plus 2 if it ends one. docs: doc_id,
    text_id, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, cols = [], [[] for _ in range(6)]
        for i, _, t in blocks(batch):
            first, last, text, same, *_ = _compared(t)
            rows.append(i + text)
            for c, v in zip(cols, (first - t.at[text], last - t.at[text], *_characters(t, first, last, text), _edges(t, first, last, text), same), strict=True):
                c.append(v)
        at = pa.array(np.concatenate(rows))
        ids = [batch.column(c).take(at) for c in ("doc_id", "text_id")]
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(np.concatenate(c), k) for c, k in zip(cols, [pa.int32()] * 4 + [pa.int8(), pa.int64()], strict=True))], ["doc_id", "text_id", "w0", "w1", "c0", "c1", "edges", "id"])

    return docs.select("doc_id", "text_id", "text").mapInArrow(per_batch(run), "doc_id long, text_id long, w0 int, w1 int, c0 int, c1 int, edges byte, id long")


def bucket_members(docs: DataFrame) -> DataFrame:
    """(key, id, hub): the paragraphs of every band key that different ones share, and one of these, the hub, to compare
    each with.

    Every batch of texts finds its own hubs first and passes on nothing but those under the key, so a key that a third
    of all paragraphs have is one row from each batch; the others already have their hub."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for _, _, t in blocks(batch):
            _, _, _, same, inside, at = _compared(t)
            same, some = np.unique(same, return_index=True)
            ids.append(same)
            keys.append(band_keys(circulant(inside, at, BANDS * ROWS), BANDS, ROWS)[some])
        one, some = np.unique(np.concatenate(ids), return_index=True)
        key = np.concatenate(keys)[some].ravel()
        row = np.repeat(np.arange(len(one)), BANDS)
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        begins = np.append(np.ones(min(len(key), 1), bool), key[1:] != key[:-1])
        hub, alone = row[np.flatnonzero(begins)[np.cumsum(begins) - 1]], begins & np.append(begins[1:], True)[: len(key)]
        place = np.where(begins, key, mix(key.view(U64) ^ mix(one[row].view(U64))).view(np.int64))
        own = pa.StructArray.from_arrays([pa.array(key), pa.array(one[hub], mask=begins)], ["key", "hub"], mask=pa.array(alone))
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(one[row]), own], ["place", "id", "own"])

    rows = docs.select("text").mapInArrow(per_batch(run), "place long, id long, own struct<key: long, hub: long>")
    of_key = Window.partitionBy("place")
    rows = rows.select("*", F.min("id").over(of_key).alias("least"), F.max("id").over(of_key).alias("greatest"))
    shared = rows.where("own is not null or least <> greatest")
    return shared.select(F.coalesce("own.key", "place").alias("key"), "id", F.coalesce("own.hub", "least").alias("hub")).distinct()


def _bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over ids; it grows on the executors and is all that the driver gets."""
    low = F.col("id").bitwiseAND((1 << FILTER_BITS) - 1)
    words = ids.groupBy(F.shiftright(low, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast((id & {(1 << FILTER_BITS) - 1}) & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    rows = words.toArrow()
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n, text) of the paragraphs with an id of ids, and of a few others that share its bit; n counts shingles."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bits(ids))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, ids, sizes, texts = bitmap.value, [], [], []
        for _, _, t in blocks(batch):
            first, last, _, same, inside, begins = _compared(t)
            low = same.view(U64) & U64((1 << FILTER_BITS) - 1)
            some = np.flatnonzero(bits[low >> U64(3)] >> (low & U64(7)).astype(np.uint8) & 1)
            one, at = np.unique(same[some], return_index=True)
            whole = t.data.tobytes()
            ids += one.tolist()
            sizes += [len(np.unique(inside[begins[k] : begins[k + 1]])) for k in some[at]]
            texts += [whole[x:y].decode("utf-8", "replace") for x, y in zip(t.start[first[some[at]]], t.end[last[some[at]] - 1], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], ["id", "n", "text"])

    return docs.select("text").mapInArrow(per_batch(run), "id long, n long, text string").groupBy("id").agg(F.first("n").alias("n"), F.first("text").alias("text"))


def repeated_passages(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, start, length, n_words, cluster_id, n_places, removed, text_id: the passages that occur in several documents.

    docs: doc_id, text; other columns are left alone. Documents are cut into paragraphs at the ends of lines of six words
    or more and, inside these and inside stretches of shorter lines, where the words themselves say so (see RADIUS), so a
    passage is found wherever in a line it stands. Paragraphs, of at least six words each, are compared by the Jaccard
    similarity of their five-word shingles: MinHash bands find candidates, whole sets verify them, and linked paragraphs
    form components. A component that touches more than one document is a cluster; its earliest paragraph, by doc_id and
    place, stays and the others are removed. Neighbouring paragraphs of a document with one fate make one passage,
    reported from RUN_WORDS words on (whole lines from WHOLE_LINES on): start and length in characters, cluster_id the least of its clusters, n_places how
    often the most frequent of them occurs, text_id a hash of the text that the passage is in.
    Nulls, empty texts and texts without words have no passages; a row that repeats is the same document, rows of one
    doc_id with different texts are judged each; an empty table gives no rows; a null doc_id is ignored.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    found = keep(paragraphs_of(docs))
    members = keep(bucket_members(docs))
    texts = keep(_texts(docs, members.select("id")))
    sized = keep(members.join(texts.select("id", "n"), "id").join(texts.select(F.col("id").alias("hub"), F.col("n").alias("nh")), "hub"))
    discard(members)
    linked = keep(near_components(sized, texts.select("id", "text"), percent, rare=True))
    discard(sized)
    discard(texts)
    classes = found.groupBy("id").agg(F.min(F.struct("doc_id", "text_id", "w0")).alias("first"), F.max("doc_id").alias("last_doc"), F.count("*").alias("places"))
    named = classes.join(linked, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = keep(named.where("label <> id or first.doc_id <> last_doc").unionByName(named.join(linked.select("label").distinct(), "label", "left_semi").where("label = id and first.doc_id = last_doc")))
    clusters = named.groupBy("label").agg(F.min("first").alias("first"), F.max("last_doc").alias("last_doc"), F.sum("places").alias("n_places")).where("first.doc_id <> last_doc").drop("last_doc")
    of_class = named.select("id", "label").join(clusters, "label")
    removed = F.struct("doc_id", "text_id", "w0") != F.col("first")
    hit = found.join(of_class, "id").select("doc_id", "text_id", "w0", "w1", "c0", "c1", "edges", "label", "n_places", removed.alias("removed"))
    hit = keep(hit.repartition("doc_id", "text_id").dropDuplicates(["doc_id", "text_id", "w0"]))
    discard(found)
    discard(named)
    order = Window.partitionBy("doc_id", "text_id").orderBy("w0")
    new = F.coalesce((F.col("w0") - F.lag("w1").over(order) > GAP) | (F.lag("removed").over(order) != F.col("removed")), F.lit(True))
    runs = hit.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    of_run = runs.groupBy("doc_id", "text_id", "run", "removed")
    whole = (F.min_by("edges", "w0").bitwiseAND(1) == 1) & (F.max_by("edges", "w0").bitwiseAND(2) == 2)
    out = of_run.agg(whole.alias("whole"), F.min("c0").cast("long").alias("start"), (F.max("c1") - F.min("c0")).cast("long").alias("length"), F.sum(F.col("w1") - F.col("w0")).alias("n_words"), F.min("label").alias("cluster_id"), F.max("n_places").alias("n_places"))
    long = F.col("n_words") >= F.when(F.col("whole"), WHOLE_LINES).otherwise(RUN_WORDS)
    return out.where(long).select("doc_id", "start", "length", "n_words", "cluster_id", "n_places", "removed", "text_id")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the removed ones of repeated_passages() taken out of text; other columns stay as they are. A row loses what was
    found in its own text: rows of one doc_id with other texts are left alone."""
    name, text_id, of_id, of_text = (fresh(docs, x) for x in ("spans", "text_of", "id_of", "hash_of"))
    spans = passages.where("removed").groupBy(F.col("doc_id").alias(of_id), F.col("text_id").alias(of_text)).agg(F.sort_array(F.collect_set(F.struct("start", "length")), False).alias(name))
    cut_out = F.expr(f"aggregate({name}, text, (t, s) -> concat(left(t, cast(s.start as int)), substr(t, cast(s.start + s.length + 1 as int))))")
    hashed = docs.withColumn(text_id, F.xxhash64("text"))
    joined = hashed.join(spans, (F.col("doc_id") == F.col(of_id)) & (F.col(text_id) == F.col(of_text)), "left")
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(cut_out)).select(docs.columns)


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
