"""Words, shingles and MinHash of whole texts, on Arrow batches inside Spark tasks.

A word is a maximal run of bytes other than space and 9-13, with A-Z lower-cased. Words are hashed with a
polynomial over random 64-bit values of their bytes, shingles with a polynomial over their words' mixed hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text taken through numpy at once; a longer text is taken alone.
BLOCK = 1 << 20
#: The same where each step reads arrays of 64-bit numbers: those stay in the cache.
SMALL_BLOCK = 1 << 18

U64, U32 = np.uint64, np.uint32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BASE, _STEP = U64(0x9E3779B97F4A7C15 | 3), U64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, U64(pow(int(_BASE), -1, 2**64)))):
            p = np.full(n, base, U64)
            p[0] = 1
            p = np.cumprod(p, dtype=U64)
            _powers[k : k + 1] = [p]
    return _powers[0], _powers[1]


class Texts:
    """A block of whole texts: bytes, where each begins and ends, and the hashes of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        solid = ~_WHITE[data]
        first, last = solid.copy(), solid.copy()
        if n:
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
            first[cuts] |= solid[cuts]
            last[cuts - 1] |= solid[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, inverse = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * p[:n], out=total[1:], dtype=U64)
        raw = (total[self.end] - total[self.start]) * inverse[self.start]
        self.word = mix(raw + (self.end - self.start).astype(U64))
        #: words of text i: word[at[i]:at[i + 1]]
        self.at = np.searchsorted(self.start, offsets)

    def shingles(self, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order, repeats included, and where each text's begin (one more at the end).

        A text of fewer words has one shingle of all its words, one without words none."""
        n = np.diff(self.at)
        counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        at = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(at[-1], U64)
        if len(self.word) >= width:
            h = np.zeros(len(self.word) - width + 1, U64)
            for j in range(width):
                h *= _STEP
                h += self.word[j : len(self.word) - width + 1 + j]
            h = mix(h)
            long = np.repeat(n >= width, counts)
            where = np.arange(at[-1]) - np.repeat(at[:-1] - self.at[:-1], counts)
            out[long] = h[where[long]]
        for i in np.flatnonzero((n > 0) & (n < width)):
            h = U64(0)
            with np.errstate(over="ignore"):
                for w in self.word[self.at[i] : self.at[i + 1]]:
                    h = h * _STEP + w
                out[at[i]] = mix(np.array([h + U64(int(n[i]) << 56)], U64))[0]
        return out, at


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets and validity of a string column; a null has no bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = np.asarray(col.is_valid())
    col = pa.array(col.fill_null("")) if col.null_count else col
    col = pa.concat_arrays([col.cast(pa.large_string())])
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), off, valid


def blocks(batch: pa.RecordBatch, name: str = "text", size: int = SMALL_BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """Texts of rows i to j, for consecutive ranges of about `size` bytes."""
    data, off, _ = column(batch, name)
    i, rows = 0, batch.num_rows
    while i < rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, Texts(data[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64))
        i = j


def decoded(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow: f on each batch that has rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return run


def distinct(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def permute(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 32-bit integers, chosen by seed."""
    x = x ^ U32(seed)
    x ^= x >> U32(16)
    x *= U32(0x85EBCA6B)
    x ^= x >> U32(13)
    x *= U32(0xC2B2AE35)
    x ^= x >> U32(16)
    return x


def circulant(hashes: np.ndarray, at: np.ndarray, k: int, first: int = 0x2545F491, second: int = 0x7A63B1C5) -> np.ndarray:
    """Circulant MinHash: signatures (texts x k) of groups of shingles that begin at `at`.

    Two permutations of [0, 2**32): the first scatters the elements, the second, circularly shifted by
    0, 1, ... k - 1, gives every coordinate as min(second[(first[x] + shift) mod 2**32]). Empty groups get all ones."""
    out = np.full((k, len(at) - 1), U32(0xFFFFFFFF), U32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        x = permute((hashes >> U64(32)).astype(U32), first)
        step, begin = 1 << 15, at[full]
        if len(x) <= step:
            for j in range(k):
                out[j, full] = np.minimum.reduceat(permute(x + U32(j), second), begin)
        else:  # in pieces that stay in the cache
            for lo in range(0, len(x), step):
                hi = min(lo + step, len(x))
                i, j = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")
                cuts, rows = np.maximum(begin[i:j], lo) - lo, full[i:j]
                for c in range(k):
                    out[c, rows] = np.minimum(out[c, rows], np.minimum.reduceat(permute(x[lo:hi] + U32(c), second), cuts))
    return out.T


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    h = np.zeros((len(signatures), bands), U64)
    for j in range(rows):
        h = mix(h + signatures[:, j : bands * rows : rows].astype(U64) + U64(1))
    return mix(h + np.arange(1, bands + 1, dtype=U64) * _STEP).view(np.int64)
