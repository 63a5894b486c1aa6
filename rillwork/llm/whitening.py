"""Whitening of embeddings by the leading components of the covariance of their distinct, quantised vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.spectrum import leading
from rillwork.llm.store import discard, keep, table

COMPONENTS = 16
STEP = 64
#: Quantised entries beyond this don't count as finite: they would not be exact.
LARGEST = 1 << 52
#: Vectors that a task multiplies at once.
ROWS = 4096


def quantised(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, floor(64 c) as int64) of the vectors of each length, without those that hold a null, a
    non-finite entry, or one too large."""
    col = batch.column(batch.schema.get_field_index(name))
    full = np.asarray(col.is_valid())
    length = np.where(full, np.nan_to_num(np.asarray(col.value_lengths().fill_null(0))), 0).astype(np.int64)
    data = np.asarray(col.flatten().cast(pa.float64()).fill_null(float("nan")))  # a null vector has no entries here
    begin = np.cumsum(length) - length
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(data[begin[rows][:, None] + np.arange(d)] * STEP)
            good = (np.abs(x) < LARGEST).all(axis=1)
        if good.any():
            yield rows[good], x[good].astype(np.int64)


def distinct_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(d, packed): each distinct quantised vector once, in two, four or eight bytes an entry. Repeats are dropped in
    every task before the shuffle."""

    def pack(batches):
        for batch in batches:
            for _, x in quantised(batch, vector):
                need = np.abs(x).max(axis=1)
                kinds = np.where(need < 1 << 15, 2, np.where(need < 1 << 31, 4, 8))
                for kind in np.unique(kinds):
                    part = x[kinds == kind].astype(f"<i{kind}")
                    cells = [r.tobytes() for r in part]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x.shape[1], np.int32)), pa.array(cells, pa.binary())], ["d", "packed"])

    return rows.select(vector).mapInArrow(pack, "d int, packed binary").distinct()


def unpacked(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """The vectors of distinct_vectors() as int64 matrices of up to ROWS rows."""
    cells = batch.column("packed").to_pylist()
    for kind in (2, 4, 8):
        own = [c for c in cells if len(c) == d * kind]
        for lo in range(0, len(own), ROWS):
            yield np.frombuffer(b"".join(own[lo : lo + ROWS]), f"<i{kind}").reshape(-1, d).astype(np.int64)


def totals(kept: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension, taken in halves so that no partial sum overflows."""

    def add(batches):
        low, high, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            for x in unpacked(batch, d):
                low, high, n = low + (x & 0x3FFFFFF).sum(axis=0), high + (x >> 26).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(low), pa.array(high), pa.array(np.full(d, n))], ["j", "low", "high", "n"])

    got = kept.mapInArrow(add, "j int, low long, high long, n long").groupBy("j").agg(F.sum("low"), F.sum("high"), F.sum("n")).orderBy("j").collect()
    return got[0][3], [r[1] + (r[2] << 26) for r in got]


def gram(kept: DataFrame, d: int, width: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of made(x)^T made(x): a triangle from each task, added up by cell."""
    upper = np.triu_indices(width)

    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for x in unpacked(batch, d):
                z = made(x)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["cell", "v"])

    got = kept.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((width, width))
    at = got["cell"].to_numpy()
    out[upper[0][at], upper[1][at]] = out[upper[1][at], upper[0][at]] = got["v"].to_numpy()
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(n x - S as doubles, the exact sum of its squares, none if no 64-bit integer holds it) of quantised rows."""
    top = max(int(np.abs(x).max()) * n, max(map(abs, sums)))
    if top < 1 << 61:
        off = x * n - np.array(sums, np.int64)
        if float(np.abs(off).max()) ** 2 * x.shape[1] < 2**62:
            return off.astype(float), (off * off).sum(axis=1).tolist()
    exact = x.astype(object) * n - np.array(sums, object)
    squares = (exact * exact).sum(axis=1)
    return exact.astype(float), [s if s < 1 << 63 else None for s in squares]


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of rows (key, vector), a row per component.

    An entry c counts as floor(64 c); a constant added to all of them would change none of these columns. The
    covariance is of the distinct quantised vectors. Only its d x d cells, sums over tasks, come to the driver, which
    finds the leading components; two more passes over the distinct vectors centre and whiten them. A null vector, an
    empty one, one with a null or non-finite entry or one of 2^52 and more (times 64) is dropped. Vectors have the most
    frequent length among the distinct ones (the longer of two equal): others are dropped. Components whose variance is
    not above rounding are left out, so fewer than two different vectors, or an empty table, give no rows. Repeated rows
    count once in the fit and are all returned, as are null keys. A deviation beyond 64 bits is null. Other columns play
    no part."""
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = keep(distinct_vectors(rows, vector))
    lengths = kept.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    kept = kept.where(F.col("d") == d)
    n, sums = totals(kept, d) if d else (0, [])

    def centred(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, sums)[0] / n

    covariance = gram(kept, d, d, centred) / n if d else np.zeros((0, 0))
    values, vectors = leading(covariance, most) if d else (np.zeros(0), np.zeros((0, 0)))
    if not len(values):
        discard(kept)
        return rows.sparkSession.createDataFrame([], schema)
    onto, k = vectors / np.sqrt(values), len(values)
    error = float(np.abs(gram(kept, d, k, lambda x: centred(x) @ onto) / n - np.eye(k)).max())
    share = values / np.trace(covariance)
    discard(kept)

    def project(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for at, x in quantised(batch, vector):
                for lo in range(0, len(at) if x.shape[1] == d else 0, ROWS):
                    off, squares = deviations(x[lo : lo + ROWS], n, sums)
                    m = len(off)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(np.repeat(at[lo : lo + ROWS], k))).cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                            pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((off / n @ onto).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                        ],
                        [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.select(key, vector).mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
