"""Language identification with hyperdimensional letter-trigram profiles."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.store import fresh, table
from rillwork.llm.text import SMALL_BLOCK, column, per_batch

#: Components of a hypervector; two random ones have a cosine of about 1 / sqrt(DIMENSIONS).
DIMENSIONS = 1024
#: Symbols: white space and other signs (0), a-z (1 to 26), all other letters dealt over the rest.
SYMBOLS = 64
GRAMS = SYMBOLS**3
#: A document's weight in its language's prototype, in whole numbers so that sums don't depend on their order.
WHOLE = 1 << 24
#: Rows of a block, however short their texts, and trigrams whose counts in them are laid out at once.
ROWS, KINDS = 2048, 1024
#: The pipeline rejects documents whose cosine with the nearest prototype is below this.
LEAST = 0.05


@cache
def _symbols() -> np.ndarray:
    """Symbol of every code point; case is folded."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return out


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random vectors of -1 and 1 for each symbol, as they stand first (permuted twice), second (once) and third."""
    v = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def hypervectors(grams: np.ndarray) -> np.ndarray:
    """Trigram vectors: the product of the three permuted letter vectors."""
    first, second, third = _letters()
    return first[grams // (SYMBOLS * SYMBOLS)] * second[grams // SYMBOLS % SYMBOLS] * third[grams % SYMBOLS]


def _grams(batch: pa.RecordBatch):
    """For blocks of rows i to j: (i, row of each trigram, trigram, whether each row has a letter).

    Every run of other signs is one gap, and a text has a gap at both ends."""
    data, off, _ = column(batch, "text")
    i, rows, of = 0, batch.num_rows, _symbols()
    while i < rows:
        j = min(i + ROWS, max(i + 1, int(np.searchsorted(off, off[i] + SMALL_BLOCK, "right")) - 1))
        points = np.frombuffer(bytes(data[off[i] : off[j]]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lengths = _characters(data, off[i : j + 1])
        ends = np.cumsum(lengths + 2)
        full = np.zeros(int(ends[-1]), np.int64)
        row = np.repeat(np.arange(j - i), lengths + 2)
        inner = np.ones(len(full), bool)
        inner[ends - 1] = inner[ends - lengths - 2] = False
        full[inner] = of[points]
        keep = np.ones(len(full), bool)
        keep[1:] = (full[1:] > 0) | (full[:-1] > 0) | (row[1:] != row[:-1])
        full, row = full[keep], row[keep]
        gram = (full[:-2] * SYMBOLS + full[1:-1]) * SYMBOLS + full[2:]
        whole = row[:-2] == row[2:]
        letters = np.zeros(j - i, bool)
        letters[row[full > 0]] = True
        yield i, row[:-2][whole], gram[whole], letters
        i = j


def _vectors(batch: pa.RecordBatch):
    """For blocks of rows: (whether each row has a letter, the sum of the vectors of its trigrams, in whole numbers)."""
    for _, row, gram, letters in _grams(batch):
        kinds, at = np.unique(gram, return_inverse=True)
        vectors = np.zeros((len(letters), DIMENSIONS), np.float32)
        for lo in range(0, len(kinds), KINDS):  # all documents of the block against some of its trigrams
            some = (at >= lo) & (at < lo + KINDS)
            width = min(KINDS, len(kinds) - lo)
            counts = np.bincount(row[some] * width + at[some] - lo, minlength=len(letters) * width).reshape(len(letters), width)
            vectors += counts.astype(np.float32) @ hypervectors(kinds[lo : lo + width]).astype(np.float32)
        yield letters, vectors


def _characters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each text: bytes that don't continue one."""
    begins = np.concatenate(([0], np.cumsum((data[off[0] : off[-1]] & 0xC0) != 0x80)))
    return np.diff(begins[off - off[0]])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the sum of each one's document vectors at length 1.

    docs: text, lang. Every document weighs the same, however long, so no repetitive one drowns the others. Only
    trigram counts travel: each task adds its own up, a sum by (lang, trigram) follows, and those are bundled by part and summed by (lang, dimension). The driver gets languages x DIMENSIONS numbers."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, row, gram, letters in _grams(batch):
                of = langs[i : i + len(letters)][row]
                share = np.rint(WHOLE / np.maximum(np.bincount(row, minlength=len(letters)), 1))[row]
                for lang in set(langs[i : i + len(letters)]):
                    add = np.bincount(gram[of == lang], share[of == lang], GRAMS).astype(np.int64)
                    total[lang] = total.get(lang, 0) + add
        for lang, n in sorted(total.items()):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "gram", "n"])

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, gram, n = np.array(batch.column("lang").to_pylist(), object), batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for lang in set(langs):
                mine = langs == lang
                for at in range(0, int(mine.sum()), 4096):
                    g, w = gram[mine][at : at + 4096], n[mine][at : at + 4096]
                    total[lang] = total.get(lang, 0) + w.astype(np.float64) @ hypervectors(g).astype(np.float64)
        for lang, v in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS)), pa.array(v)], ["lang", "d", "v"])

    counts = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(bundle, "lang string, d long, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["v"]
    langs = sorted(found)
    matrix = np.stack([found[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))
    return langs, (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identify(docs: DataFrame, train: DataFrame, carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text), learned from train (text, lang).

    A trigram's vector binds the permuted random vectors of its letters, a document's bundles those of all its
    trigrams, a language's those of all its documents; the nearest prototype by cosine is predicted and the cosine,
    cut to 0 to 1, is the score. Ties go to the first language in order. A text that is null or has no letter, and any
    text where nothing could be learned, is `und` with score 0. Training rows without text or lang are left out. Rows
    that repeat are predicted alike; an empty table gives no rows; other columns are left alone, or with carry those
    columns come instead of doc_id, beside the prediction under names.
    """
    langs, matrix = prototypes(train.where("text is not null and lang is not null"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score = [], []
        for letters, vectors in _vectors(batch):
            cosine = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            top = cosine.argmax(1) if langs else np.zeros(len(letters), int)
            known = letters & bool(langs)
            best += [langs[t] if k else "und" for t, k in zip(top, known, strict=True)]
            score += [float(min(1, max(0, cosine[i, t]))) if k else 0.0 for i, (t, k) in enumerate(zip(top, known, strict=True))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*kept, *names])

    kept = carry or ["doc_id"]
    schema = T.StructType(docs.select(*kept).schema.fields).add(names[0], "string").add(names[1], "double")
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(per_batch(run), schema)


HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(f"not coalesce({HELD_OUT}, true)"))
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters, or near no learned language, go. Each row is judged by its own text,
    whatever its doc_id."""
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = identify(docs, docs.where(f"not coalesce({HELD_OUT}, true)"), docs.columns, (pred, score))
    return found.where(F.col(pred) != "und").where(F.col(score) >= LEAST).select(docs.columns)
