"""A quality classifier: interpolated modified Kneser-Ney perplexity against trusted text, and what speaks for labelled bad text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm.store import BROADCAST_IDS, cut, discard, keep, table
from rillwork.llm.text import U64, decoded, mix

#: Characters of the longest n-gram, and the bits that each takes: an n-gram is one 64-bit number.
ORDER, BITS = 5, 12
#: A gram that is more likely in bad text by over STRONG (log) is evidence, by what it exceeds that.
STRONG = 2.0
#: Thresholds are these quantiles of a language's trusted documents.
QUANTILE, BAD_QUANTILE = 0.99, 0.98
#: Labelled documents that no model learns from; thresholds are fitted on the trusted ones of them. A language with fewer
#: than LEAST_HELD trusted ones among them has too few to tell a quantile: it learns from and is fitted on all.
HELD_OUT, LEAST_HELD = "coalesce(crc32(cast(doc_id as string)) % 8 = 0, false)", 20
#: Steps of log perplexity and of evidence in which quantiles are counted.
STEP = 1e-3
#: At most so many of the most frequent n-grams reach documents by broadcast (under 8 MB); all others are joined.
HEAD, SLOTS = 262_144, 1 << 21
#: n-grams that a counting task holds before it adds equal ones up, and distinct ones before it passes them on.
PENDING, FLUSH = 1 << 22, 1 << 21
#: Scan partitions that one counting task takes, so that few tasks repeat the frequent n-grams.
TOGETHER = 8
#: What stands before a text, as often as a full n-gram needs, and the space that begins it.
EDGE = "\x01" * (ORDER - 1) + " "


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams that end at each character of each text, in order, and where each text's begin.

    White space is one space, and one ends the text; n-grams cross the ends of words. Characters beyond U+07FF share the
    upper half of the 4,096 codes by a hash. A text without words has none."""
    spaced = [f"{EDGE}{s} " if (s := " ".join(t.split())) else "" for t in texts]
    code = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if (high := code >= 2048).any():
        code[high] = 2048 + (code[high] * 2654435761 >> 7) % 2048
    sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
    at = np.concatenate(([0], np.cumsum(np.maximum(sizes - len(EDGE), 0))))
    if not len(code):
        return np.zeros(0, np.int64), at
    packed = np.zeros(len(code), np.int64)
    for j in range(ORDER):
        packed[ORDER - 1 :] |= code[ORDER - 1 - j : len(code) - j] << (BITS * j)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    inner = np.ones(len(code), bool)
    for j in range(len(EDGE)):
        inner[first + j] = False
    return packed[inner], at


def _slices(texts: list[str], size: int = 1 << 18):
    """Ranges of texts of about `size` characters; a longer one goes alone."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if total and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, trusted, bad, seen): how often each n-gram occurs in trusted, in bad and in all documents.

    docs: lang, trusted, text and, where there are any, bad. Each task adds its own n-grams up before the shuffle."""

    def run(batches):
        held: dict[tuple, list] = {}
        pending = 0

        def add_up() -> int:
            for key, parts in held.items():
                if len(parts) > 1:
                    g, n = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
                    order = np.argsort(g, kind="stable")  # merges runs that are sorted
                    g = g[order]
                    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    held[key] = [(g[first], np.add.reduceat(n[order], first))]
            return sum(len(p[0]) for parts in held.values() for p in parts)

        def rows():
            add_up()
            for lang in sorted({k[0] for k in held}):
                kinds = [(k[1], *held[k][0]) for k in held if k[0] == lang]
                g, back = np.unique(np.concatenate([x[1] for x in kinds]), return_inverse=True)
                n = np.concatenate([x[2] for x in kinds])
                kind = np.repeat([x[0] for x in kinds], [len(x[1]) for x in kinds])
                total = [np.bincount(back, n * (kind == k), len(g)).astype(np.int64) for k in (1, 2)] + [np.bincount(back, n, len(g)).astype(np.int64)]
                for i in range(0, len(g), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[part]), pa.string()), pa.array(g[part]), *(pa.array(t[part]) for t in total)], ["lang", "gram", "trusted", "bad", "seen"])
            held.clear()

        for batch in batches:
            texts = decoded(batch)
            kinds = list(zip(batch.column("lang").to_pylist(), (2 if b else 1 if t else 0 for t, b in zip(batch.column("trusted").to_pylist(), batch.column("bad").to_pylist(), strict=True)), strict=True))
            for i, j in _slices(texts, 1 << 20):
                grams, at = grams_of(texts[i:j])
                of: dict[tuple, list] = {}
                for r in range(i, j):
                    if at[r - i] < at[r - i + 1]:
                        of.setdefault(kinds[r], []).append(grams[at[r - i] : at[r - i + 1]])
                for key, some in of.items():
                    g, n = np.unique(np.concatenate(some), return_counts=True)
                    held.setdefault(key, []).append((g, n))
                    pending += len(g)
                if pending >= PENDING:
                    pending = add_up()
                    if pending >= FLUSH:
                        yield from rows()
                        pending = 0
        yield from rows()

    bad = F.col("bad") if "bad" in docs.columns else F.lit(False).alias("bad")
    few = max(2 * docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // TOGETHER)
    found = docs.select("lang", "trusted", bad, "text").coalesce(few).mapInArrow(run, "lang string, gram long, trusted long, bad long, seen long")
    return found.groupBy("lang", "gram").agg(F.sum("trusted").alias("trusted"), F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, seen, logp, ratio) for every gram of counts (lang, gram, trusted, bad, seen), a materialised table:
    logp is the log probability of its last character after the others by the model of trusted text, ratio the same by
    the model of bad text less logp (0 where a language has no bad text). Each lang has models of its own.

    Interpolated modified Kneser-Ney: n-grams of full order count by occurrence, shorter ones by the number of different
    characters before them. Each order has the discounts D1, D2 and D3+ from its counts of counts; where these give none
    above 0 (few or odd n-grams) they are 0.5, 1 and 1.5. What they hold back goes to the shorter context, at last to a
    uniform choice among the language's characters and one more. An unknown context leaves all to the shorter one.

    n-grams of each order are grouped by their ends, so every order is smaller than the one above; what a context holds
    back is a window over the at most 4,096 n-grams that continue it, and each order joins the next shorter by its end.
    """
    kinds, end = ("trusted", "bad"), lambda n: F.col("gram").bitwiseAND((1 << BITS * n) - 1)
    lower, now = None, counts
    for n in range(order - 1, 0, -1):
        now = now.groupBy("lang", end(n).alias("gram")).agg(*[F.count_if(F.col(k) > 0).alias(k) for k in kinds])
        one = now.select("lang", F.lit(n).alias("n"), "gram", *kinds)
        lower = one if lower is None else lower.unionByName(one)
    full = counts.select("lang", F.lit(order).alias("n"), "gram", *kinds)
    if lower is not None:
        lower = keep(lower)
        full = full.unionByName(lower)
    tally = full.groupBy("lang", "n").agg(*[F.count_if(F.col(k) == i).alias(f"{k}{i}") for k in kinds for i in (1, 2, 3, 4)], *[F.count_if(F.col(k) > 0).alias(f"{k}_kinds") for k in kinds])
    tally = cut(tally)
    for k in kinds:
        y, good = F.expr(f"try_divide({k}1, {k}1 + 2.0 * {k}2)"), F.expr(" and ".join(f"{k}{i} > 0" for i in (1, 2, 3, 4)))
        for i in (1, 2, 3):
            d = F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"{k}{i + 1}"), F.col(f"{k}{i}"))
            tally = tally.withColumn(f"{k}_d{i}", F.when(good & (d > 0), d).otherwise(0.5 * i))
    below = None
    for n in range(1, order + 1):
        level = counts if n == order else lower.where(F.col("n") == n)
        level = level.join(F.broadcast(tally.where(F.col("n") == n).drop("n")), "lang")
        context = Window.partitionBy("lang", F.shiftright("gram", BITS))
        out = ["lang", "gram"] + (["seen"] if n == order else [])
        for k in kinds:
            c = F.col(k)
            level = level.withColumn(f"{k}_d", F.when(c > 0, F.least(F.when(c == 1, F.col(f"{k}_d1")).when(c == 2, F.col(f"{k}_d2")).otherwise(F.col(f"{k}_d3")), c.cast("double"))).otherwise(0.0))
        for k in kinds:
            level = level.withColumn(f"{k}_all", F.sum(k).over(context)).withColumn(f"{k}_held", F.sum(f"{k}_d").over(context))
        if below is None:
            level = level.select("*", *[(1.0 / (F.col(f"{k}_kinds") + 1)).alias(f"{k}_p") for k in kinds])
        else:
            level = level.withColumn("rest", end(n - 1)).join(below, ["lang", "rest"])
        p = [F.when(F.col(f"{k}_all") > 0, (F.col(k) - F.col(f"{k}_d") + F.col(f"{k}_held") * F.col(f"{k}_p")) / F.col(f"{k}_all")).otherwise(F.col(f"{k}_p")).alias(f"{k}_q") for k in kinds]
        level = level.select(*out, *p)
        if n < order:
            below = level.select("lang", F.col("gram").alias("rest"), *[F.col(f"{k}_q").alias(f"{k}_p") for k in kinds])
    any_bad = tally.where((F.col("n") == order) & (F.col("bad_kinds") > 0)).select("lang", F.lit(True).alias("any_bad"))
    ratio = F.when(F.col("any_bad"), F.log("bad_q") - F.log("trusted_q")).otherwise(0.0)
    return level.join(F.broadcast(any_bad), "lang", "left").select("lang", "gram", "seen", F.log("trusted_q").alias("logp"), ratio.alias("ratio"))


class _Head:
    """The broadcast n-grams of one language, found by the upper bits of a hash; of two in one slot one is left out."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, ratio: np.ndarray):
        slot = self.slots(grams)
        self.keys, self.at = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        self.keys[slot], self.at[slot] = grams, np.arange(len(grams))
        self.logp, self.ratio = logp, ratio

    @staticmethod
    def slots(grams: np.ndarray) -> np.ndarray:
        return (mix(grams.astype(U64)) >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are known, and the places of all."""
        slot = self.slots(grams)
        return self.keys[slot] == grams, self.at[slot]


def _frequent(model: DataFrame, most: int) -> DataFrame:
    """The n-grams that occur oftenest, no more than `most`: all from a frequency on, which a histogram of bounded size tells."""
    bins = F.when(F.col("seen") < 4096, F.col("seen")).otherwise(F.floor(F.log2("seen") * 16) + 4096)
    total, least = 0, None
    for r in model.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min("seen").alias("least")).orderBy(F.desc("bin")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return model.where(F.lit(False) if least is None else F.col("seen") >= least)


def document_scores(docs: DataFrame, model: DataFrame, head: int = HEAD) -> DataFrame:
    """(rid, doc_id, lang, trusted, n_chars, n_grams, log_prob, evidence) per row of docs (doc_id, lang, trusted, text).

    n_chars counts the characters of words and the spaces behind them, n_grams the different n-grams; evidence adds up
    what the ratios of these exceed STRONG by. Documents' n-gram counts meet the model in two ways: the `head` most
    frequent ones through a broadcast of that size, all others through a join by (lang, gram)."""
    held = docs.sparkSession.sparkContext.broadcast(_frequent(model, head).select("lang", "gram", "logp", "ratio").toArrow())
    names = ["rid", "lang", "gram", "times", "doc_id", "trusted", "n_chars", "n_grams", "log_prob", "evidence"]

    def run(batches):
        top, row, heads = held.value, TaskContext.get().partitionId() << 33, {}
        langs, (all_grams, logp, ratio) = np.array(top["lang"].to_pylist(), object), (top[c].to_numpy() for c in ("gram", "logp", "ratio"))
        for batch in batches:
            texts, of, ids, flags = decoded(batch), batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("trusted").to_pylist()
            for i, j in _slices(texts):
                whole, at = grams_of(texts[i:j])
                cols: list[list] = [[] for _ in names]
                rare: list[tuple] = []
                for r in range(i, j):
                    row += 1
                    if of[r] not in heads:
                        mine = langs == of[r]
                        heads = {} if len(heads) >= 8 else heads
                        heads[of[r]] = _Head(all_grams[mine], logp[mine], ratio[mine]) if mine.any() else None
                    grams, times = np.unique(whole[at[r - i] : at[r - i + 1]], return_counts=True)
                    lookup, log_prob, evidence = heads[of[r]], 0.0, 0.0
                    if lookup is not None and len(grams):
                        known, place = lookup(grams)
                        place = place[known]
                        log_prob = float((lookup.logp[place] * times[known]).sum())
                        evidence = float(np.maximum(lookup.ratio[place] - STRONG, 0).sum())
                        rare.append((row, of[r], grams[~known], times[~known]))
                    else:
                        rare.append((row, of[r], grams, times))
                    for c, v in zip(cols, (row, of[r], -row, 1, ids[r], flags[r], int(times.sum()), len(grams), log_prob, evidence), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                sizes = [len(x[2]) for x in rare]
                n = sum(sizes)
                if n:
                    lang = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(rare)), sizes)), pa.array([x[1] for x in rare], pa.string())).cast(pa.string())
                    some = [pa.array(np.repeat([x[0] for x in rare], sizes)), lang, pa.array(np.concatenate([x[2] for x in rare])), pa.array(np.concatenate([x[3] for x in rare]))]
                    yield pa.RecordBatch.from_arrays([*some, *(pa.nulls(n, k) for k in kinds[4:])], names)

    rows = docs.select("doc_id", "lang", "trusted", "text").mapInArrow(run, "rid long, lang string, gram long, times long, doc_id long, trusted boolean, n_chars long, n_grams long, log_prob double, evidence double")
    joined = rows.join(model.select("lang", "gram", "logp", "ratio"), ["lang", "gram"], "left")
    log_prob = F.coalesce("log_prob", F.col("times") * F.coalesce("logp", F.lit(0.0)))
    evidence = F.coalesce("evidence", F.greatest(F.coalesce("ratio", F.lit(0.0)) - STRONG, F.lit(0.0)))
    most = [F.max(c).alias(c) for c in ("doc_id", "lang", "trusted", "n_chars", "n_grams")]
    return joined.groupBy("rid").agg(*most, F.sum(log_prob).alias("log_prob"), F.sum(evidence).alias("evidence"))


def _quantile(rows: DataFrame, value: str, name: str, quantile: float) -> DataFrame:
    """(lang, name): the quantile of value over each language's rows, rounded up to a STEP."""
    bins = rows.where(F.col(value).isNotNull()).groupBy("lang", F.ceil(F.col(value) / STEP).alias("bin")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("lang").orderBy("bin")
    reached = bins.withColumn("below", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return reached.where(F.col("below") >= quantile * F.col("all")).groupBy("lang").agg((F.min("bin") * STEP).alias(name))


def score_quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, bad: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, n_chars, log_prob, perplexity, threshold, badness, badness_threshold, kept for every row of docs
    (doc_id, lang, text).

    trusted has the doc_ids of documents to learn from; each language has a model of its own, of n-grams of characters
    that cross the ends of words. perplexity is per character, words' ends included. bad has the doc_ids of documents
    that are known to be bad or toxic: a second model learns from them. An n-gram that it makes more likely by over
    STRONG is evidence against a document, counted once however often it occurs; badness is the evidence by the root of
    the number of different n-grams, so a few marked words count in a long document too. Thresholds are quantiles of
    each language's trusted documents that are HELD_OUT of all counts (of all its trusted ones where those are too
    few), to one part in a thousand. Documents up to both are kept.

    A null lang is the language `und`. A null or empty text, or one of white space, has no perplexity and isn't kept.
    Where a language has no trusted text nothing can be said: perplexity and thresholds are null and the document is
    kept; where it has no bad text, badness is 0. Rows that repeat are scored each; an empty table gives no rows; other
    columns are left alone; a null doc_id is scored and not learned from; an id that is both trusted and bad is bad.
    """
    ids = trusted.select("doc_id", F.lit(False).alias("bad"))
    ids = ids if bad is None else ids.unionByName(bad.select("doc_id", F.lit(True).alias("bad")))
    ids = cut(ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad")))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text").join(ids, "doc_id", "left")
    enough = cut(named.where(f"not bad and {HELD_OUT}").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_HELD).select("lang", F.lit(True).alias("split")))
    named = named.join(F.broadcast(enough), "lang", "left").withColumn("held", F.expr(f"coalesce(split, false) and {HELD_OUT}"))
    named = named.select("doc_id", "lang", "text", F.expr("coalesce(not bad and not held, false)").alias("trusted"), F.expr("coalesce(bad and not held, false)").alias("bad"), F.expr("coalesce(not bad and held = coalesce(split, false), false)").alias("fit"))
    counts = keep(gram_counts(named))
    model = keep(kneser_ney(counts))
    has = cut(counts.where("trusted > 0").select("lang").distinct().withColumn("has", F.lit(True)))
    discard(counts)
    scored = keep(document_scores(named.withColumn("trusted", F.col("fit")), model))
    discard(model)
    known = F.col("has") & (F.col("n_chars") > 0)
    judged = scored.join(F.broadcast(has), "lang", "left").withColumn("log_ppl", F.when(known, -F.col("log_prob") / F.col("n_chars"))).withColumn("badness", F.when(known, F.col("evidence") / F.sqrt("n_grams")))
    fit = judged.where("trusted")
    limits = _quantile(fit, "log_ppl", "log_limit", quantile).join(_quantile(fit, "badness", "badness_threshold", BAD_QUANTILE), "lang")
    out = judged.join(F.broadcast(limits), "lang", "left")
    kept = F.when(F.col("n_chars") == 0, False).when(F.col("log_limit").isNull(), True).otherwise((F.col("log_ppl") <= F.col("log_limit")) & (F.col("badness") <= F.col("badness_threshold")))
    return out.select("doc_id", "lang", "n_chars", "log_prob", F.exp("log_ppl").alias("perplexity"), F.exp("log_limit").alias("threshold"), "badness", "badness_threshold", kept.alias("kept"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = F.expr("quality = 1 and coalesce(toxic, 0) = 0")
    return score_quality(table(spark, sf_dir, "documents"), labels.where(good), bad=labels.where("quality = 0 or toxic = 1"))
