"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.store import cut, most_frequent, table
from rillwork.llm.text import decoded

#: The most frequent pre-tokens, of at most LONGEST characters, that are broadcast with their counts (under 70 MB).
HEAD, LONGEST = 262_144, 64
#: Distinct pre-tokens that a task adds up before it passes them on.
FLUSH = 400_000
LIMIT = 4096

_CHUNK = re.compile(" *[^ ]+| +")


def pretokens(text: str) -> list[str]:
    """What the merges never cross: a run of spaces and what follows it, without the first space.

    The model turns spaces to U+2581, puts one in front, and has no piece with U+2581 behind another character, so
    the pieces of a text are those of its pre-tokens. An empty pre-token is a lone space at the end: one piece."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _CHUNK.findall(" " + text)]
    return text.split(" ")


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """(token, freq, n): every distinct pre-token of docs (text), how often it occurs and how many pieces it has."""

    def add_up(batches):
        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["token", "freq"])
            total.clear()
            return out

        total: Counter[str] = Counter()
        for batch in batches:
            for text in decoded(batch):
                total.update(pretokens(text))
                if len(total) >= FLUSH:
                    yield rows()
        yield rows()

    def count(batches):
        encode = _model(model).encode
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            n = [len(x) if t else 1 for t, x in zip(tokens, encode(tokens, num_threads=1), strict=True)] if tokens else []
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("freq"), pa.array(n, pa.int64())], ["token", "freq", "n"])

    return docs.select("text").mapInArrow(add_up, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq")).mapInArrow(count, "token string, freq long, n long")


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    Each distinct pre-token is encoded once. Its count joins the documents' pre-token frequencies: the `head` most
    frequent short ones through a broadcast of that size, all others through a shuffled join, and no ids are kept.
    A null text is empty: 0 bytes, 0 tokens. Rows that repeat are counted each; an empty table gives no rows; other
    columns are left alone; a null doc_id is kept.
    """
    known = cut(vocabulary(docs, model))
    top = most_frequent(known.where(F.length("token") <= LONGEST), "freq", head).select("token", "n")
    frequent = docs.sparkSession.sparkContext.broadcast({r["token"]: r["n"] for r in top.toLocalIterator()})

    def split(batches):
        """A row for each rare pre-token of a document, and one (whose token no pre-token equals) for the rest of it."""
        n_of, row = frequent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            rid, token, times, doc, size = [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), decoded(batch), strict=True):
                row, total = row + 1, 0
                for t, k in Counter(pretokens(text)).items():
                    if (n := n_of.get(t)) is not None:
                        total += n * k
                    else:
                        rid.append(row), token.append(t), times.append(k), doc.append(None), size.append(None)
                rid.append(row), token.append(f"x {row}"), times.append(total), doc.append(d), size.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(token, pa.string()), pa.array(times, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int64())], ["rid", "token", "times", "doc_id", "n_bytes"])

    rows = docs.select("doc_id", "text").mapInArrow(split, "rid long, token string, times long, doc_id long, n_bytes long")
    counted = rows.join(known.select("token", "n"), "token", "left").withColumn("n", F.col("times") * F.coalesce("n", F.lit(1)))
    out = counted.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_model())
