"""A media column: bytes kept losslessly as FLAC, read back in blocks with sample offsets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import flac
from rillwork.llm.store import table
from rillwork.llm.text import column, per_batch

#: Bytes of payload that are coded at once, and of media that are decoded at once; one longer row goes alone.
ENCODE, DECODE = 1 << 20, 4 << 20


def _spans(off: np.ndarray, size: int):
    i, rows = 0, len(off) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of docs (doc_id, text): the text's UTF-8 bytes (null: none), then bytes 0 up
    to a positive multiple of 64, as an 8-bit mono FLAC stream with a seek point for every frame."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off, _ = column(batch, "text")
        whole, media = data.tobytes(), []
        for i, j in _spans(off, ENCODE):
            texts = [whole[off[r] : off[r + 1]] for r in range(i, j)]
            media += flac.encode([t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(per_batch(run), "doc_id long, n_bytes long, media binary")


def _decoded(batch: pa.RecordBatch):
    """(row, media bytes, decoded) for every row."""
    media = [x or b"" for x in batch.column("media").to_pylist()]
    off = np.cumsum([0, *map(len, media)])
    for i, j in _spans(off, DECODE):
        some = [r for r in range(i, j) if media[r]]
        for r, d in zip(some, flac.decode([media[r] for r in some]), strict=True):
            yield r, media[r], d


def _blocks(d):
    """(block, sample_offset, n_samples, byte_offset, byte_length, pcm) of a decoded stream's frames."""
    pcm = (d.samples.view(np.uint8) ^ 128).tobytes()
    for k, f in enumerate(d.frames):
        yield k, *map(int, f), pcm[f[0] : f[0] + f[1]]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row per FLAC frame of each row of media (doc_id, media): block, sample_offset, n_samples, byte_offset in the
    stream, byte_length, and pcm, the samples as unsigned bytes. A reader that wants sample s takes the block with the
    greatest sample_offset up to s. A null stream has no rows; a broken one raises BadStream."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column("doc_id").to_pylist(), []
        for r, _, d in _decoded(batch):
            rows += [(ids[r], *b) for b in _blocks(d)]
        names = ["doc_id", "block", "sample_offset", "n_samples", "byte_offset", "byte_length", "pcm"]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "pcm" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(per_batch(run), "doc_id long, block long, sample_offset long, n_samples long, byte_offset long, byte_length long, pcm binary")


def feature(samples: np.ndarray) -> str:
    """Peak, mean, root mean square and zero crossings of 8-bit samples."""
    n = len(samples)
    wide = samples.astype(np.int32)
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    return f"n={n};peak={int(np.abs(wide).max(initial=0))};mean={int(wide.sum()) / max(n, 1):.4f};rms={(int((wide * wide).sum(dtype=np.int64)) / max(n, 1)) ** 0.5:.4f};crossings={crossings}"


def digest(media: DataFrame) -> DataFrame:
    """What the stored bytes give when read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, n_blocks, last_sample_offset, feature. The payload is put together from the PCM blocks, each at its
    sample offset. A null media column has no row; an empty table gives none; rows that repeat are read each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, rows = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), []
        for r, stored, d in _decoded(batch):
            payload, last = bytearray(len(d.samples)), 0
            for _, last, n, _, _, pcm in _blocks(d):
                payload[last : last + n] = pcm
            rows.append((ids[r], sizes[r], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(d.frames), last, feature(d.samples)))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_blocks", "last_sample_offset", "feature"]
        cols = list(zip(*rows, strict=True)) or [[]] * 10
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") or n == "feature" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return media.mapInArrow(per_batch(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_blocks long, last_sample_offset long, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; a null text is an empty one. Equal texts give equal values; rows that repeat are kept; a very
    long text is coded frame by frame; an empty table gives no rows; other columns of documents are left out."""
    return digest(encode_media(table(spark, sf_dir, "documents")))
