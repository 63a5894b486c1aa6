"""Log-probabilities of whole texts by a log-bilinear model of frequent words and spelling classes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.log_bilinear import CONTEXT, WIDTH, Model, Trainer, initial, laid_out, log_probs
from rillwork.llm.store import discard, keep, most_frequent, table
from rillwork.llm.text import Texts, blocks

#: Units: the end, the most frequent words, and classes of all other words by their last two bytes.
SINGLE, CLASSES = 64, 192
#: What a count gets on top, in the base and inside a class.
EXTRA = 0.1
#: The most frequent words whose counts are broadcast (16 bytes each).
HEAD = 262_144
#: Distinct words that a task adds up before it passes them on.
FLUSH = 1_000_000
#: The end of a text, as a word.
END = np.uint64(0)
#: Of this many shares of the training documents the first gives all tasks a common start, the others then improve it.
SHARES = 8


def remainders(batch: pa.RecordBatch) -> np.ndarray:
    """crc32 of each doc_id as text; a null one is the empty text."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) for d in batch.column("doc_id").to_pylist()], np.int64)


def spelling(texts: Texts) -> np.ndarray:
    """The class of each word, by its last two bytes (A-Z lower-cased)."""
    last, before = texts.data[texts.end - 1].astype(np.int64), texts.data[np.maximum(texts.end - 2, texts.start)].astype(np.int64)
    lower = lambda b: b + 32 * ((b >= 65) & (b <= 90))
    return (lower(before) * 31 + lower(last) * 7) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, c): words of the training documents by their hashes, the end among them (its class is none)."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, classes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        unique, first, back = np.unique(words, return_index=True, return_inverse=True)
        return unique, classes[first], np.bincount(back, counts, len(unique)).astype(np.int64)

    def count(batches):
        def out() -> pa.RecordBatch:
            words, classes, counts = parts.pop()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(classes.astype(np.int32)), pa.array(counts)], ["word", "class", "c"])

        parts, waiting, ends = [], 0, 0
        for batch in batches:
            for i, j, texts in blocks(batch):
                learned = remainders(batch.slice(i, j - i)) % 10 != 0
                ends += int(learned.sum())
                mine = np.repeat(learned, np.diff(texts.at))
                parts.append((texts.word[mine], spelling(texts)[mine], np.ones(int(mine.sum()))))
                waiting += len(parts[-1][0])
                if waiting >= FLUSH:
                    parts = [merged(parts)]
                    waiting = len(parts[0][0])
                    if waiting >= FLUSH // 2:
                        yield out()
                        waiting = 0
        parts.append((np.full(1, END), np.full(1, -1), np.full(1, ends)))
        parts = [merged(parts)]
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word long, class int, c long").groupBy("word").agg(F.min("class").alias("class"), F.sum("c").alias("c"))
    return counted.where("c > 0")


@dataclass
class Units:
    """The single words (hashes, sorted, with their units), the units' shares of all training tokens, and log10 of the
    mass of each class, unknown words included."""

    words: np.ndarray
    unit: np.ndarray
    share: np.ndarray
    mass: np.ndarray

    def of(self, texts: Texts) -> np.ndarray:
        """The unit of each word."""
        out = len(self.words) + spelling(texts)
        place = np.minimum(np.searchsorted(self.words, texts.word), len(self.words) - 1)
        found = self.words[place] == texts.word
        out[found] = self.unit[place[found]]
        return out

    def lines(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of a block, an end behind each text's words; where each text begins; which are words."""
        at = texts.at + np.arange(len(texts.at))
        word = np.ones(at[-1], bool)
        word[at[1:] - 1] = False
        out = np.zeros(at[-1], np.int64)
        out[word] = self.of(texts)
        return out, at, word


def units_of(counts: DataFrame) -> Units:
    """Unit 0 is the end, then come the most frequent words (equal ones by hash), then the classes."""
    end = int(END)
    top = counts.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(SINGLE - 1).collect()
    ends = counts.where(F.col("word") == end).collect()
    words = np.array([end, *(r["word"] for r in top)], np.int64).view(np.uint64)
    rest = counts.where(~F.col("word").isin([int(w) for w in words.view(np.int64)])).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    seen, mass = np.zeros(CLASSES), np.full(CLASSES, EXTRA)
    for r in rest:
        seen[r["class"]] = r["c"]
        mass[r["class"]] += r["c"] + EXTRA * r["n"]
    share = np.array([*(r["c"] for r in ends or [{"c": 0}]), *(r["c"] for r in top), *seen], float) + 1
    order = np.argsort(words)
    return Units(words[order], order.astype(np.int64), share / share.sum(), np.log10(mass))


def trained(docs: DataFrame, units: Units) -> Model:
    """The model of all training documents: each task learns from its own, and parameters are averaged by tokens.

    An eighth of the documents gives the start that all tasks share, the rest is learned from there: every document is
    learned from once. What a task passes on is its parameters, some 600 rows of WIDTH numbers."""
    share, n = units.share, len(units.share)
    model = initial(share)
    for first in (True, False):
        start = model

        def learn(batches, start=start, first=first):
            trainer = Trainer(start, share, TaskContext.get().partitionId())
            for batch in batches:
                for i, j, texts in blocks(batch):
                    own = remainders(batch.slice(i, j - i))
                    mine = (own % 10 != 0) & ((own // 10 % SHARES == 0) == first)
                    line, at, _ = units.lines(texts)
                    pick = np.repeat(mine, np.diff(at))
                    if pick.any():
                        trainer.learn(laid_out(line[pick], np.concatenate([[0], np.cumsum(np.diff(at)[mine])]), n)[0])
            rows = trainer.finish().rows()
            if trainer.tokens:
                v = [pa.array(rows[:, k].astype(float) * trainer.tokens) for k in range(WIDTH)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), trainer.tokens)), *v], ["row", "tokens", *names])

        names = [f"v{k}" for k in range(WIDTH)]
        parts = docs.select("doc_id", "text").mapInArrow(learn, "row int, tokens long, " + ", ".join(f"{v} double" for v in names))
        got = parts.groupBy("row").agg(F.sum("tokens").alias("tokens"), *[F.sum(v).alias(v) for v in names]).toPandas().sort_values("row")
        if len(got):
            model = Model.of_rows(got[names].to_numpy() / got[["tokens"]].to_numpy(), n)
    return model


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are the words of the whole text, A-Z lower-cased, and one end. Training documents are those whose crc32 of
    the doc_id as text is no multiple of ten. score is log10 of the product over tokens of the unit's probability, given
    the five tokens before, normalised over all 256 units, times the word's share of its class: (c + 0.1) over the
    class's sum of that and one unknown word's 0.1. So it adds up to one over all words, each class having one unknown.
    Counts of all words of all training documents are used: of the most frequent through a broadcast of HEAD of them, of
    the others through a join by word.

    A null text is empty: one token, the end. A null doc_id counts as the empty text, so it is held out. Repeated rows
    are scored, and learned from, each. Without training documents every word is unknown and units are equally likely.
    An empty table gives no rows; other columns are left alone. Words are 64-bit hashes of their bytes."""
    counts = keep(word_counts(docs))
    n_train, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    units = units_of(counts)
    model = trained(docs, units)
    held = most_frequent(counts, "c", HEAD).select("word", "c").toArrow()
    words = held["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    head = docs.sparkSession.sparkContext.broadcast((words[order], np.log10(held["c"].to_numpy()[order] + EXTRA)))
    low = math.log10(n_train + EXTRA * (n_distinct + 1))
    names = ["rid", "word", "times", "single", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def pieces(texts: Texts, rid: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Sums of each text over what is known here, and its other words."""
        top, logs = head.value
        line, at, is_word = units.lines(texts)
        text = np.repeat(np.arange(len(rid)), np.diff(at))
        word = np.full(len(line), END)
        word[is_word] = texts.word
        laid, place = laid_out(line, at, len(units.share))
        score = log_probs(model, laid)[place - CONTEXT] / math.log(10)
        spread = line >= len(units.words)  # words that share their unit
        score[spread] -= units.mass[line[spread] - len(units.words)]
        near = np.minimum(np.searchsorted(top, word), max(len(top) - 1, 0))
        found = top[near] == word if len(top) else np.zeros(len(word), bool)
        base = np.where(found, logs[near] if len(top) else 0.0, 0.0)
        score += np.where(spread, base, 0)
        add = lambda v: np.bincount(text, v, len(rid))
        yield add(base), add(score), add(found), np.diff(at)
        far = np.flatnonzero(~found)
        by = np.lexsort((word[far], text[far]))
        far = far[by]
        new = np.ones(len(far), bool)
        new[1:] = (word[far][1:] != word[far][:-1]) | (text[far][1:] != text[far][:-1])
        first = np.flatnonzero(new)
        yield rid[text[far[first]]], word[far[first]], np.diff(np.append(first, len(far))), ~spread[far[first]]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, texts in blocks(batch):
                rid = np.arange(row, row + j - i)
                row += j - i
                (base, score, known, tokens), (r, w, times, single) = pieces(texts, rid)
                n, m = j - i, len(r)
                own = [pa.array(rid), pa.array(-1 - rid), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.bool_()), ids.slice(i, n), pa.array(remainders(batch.slice(i, n)) % 10 == 0), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
                rest = [pa.array(r), pa.array(w.view(np.int64)), pa.array(times), pa.array(single), *(pa.nulls(m, k) for k in kinds[4:])]
                yield pa.RecordBatch.from_arrays(own, names)
                if m:
                    yield pa.RecordBatch.from_arrays(rest, names)

    schema = "rid long, word long, times long, single boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    joined = rows.join(counts.select("word", "c"), "word", "left")
    log_c = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(EXTRA))
    plus = F.when(F.col("times") > 0, log_c).otherwise(0.0)
    sums = [F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")]
    known = F.sum(F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("times")), F.lit(0)))
    got = joined.groupBy("rid").agg(*sums, known.alias("n_known"), F.sum(F.coalesce("base", F.lit(0.0)) + plus).alias("base"), F.sum(F.coalesce("score", F.lit(0.0)) + F.when(F.col("single"), 0.0).otherwise(plus)).alias("score"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * low).alias("base_score"), "score")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
