"""Signals in zip archives as a partitioned source: entries are listed once, ranges of an entry are read side by side."""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Uncompressed bytes of an entry that a partition reads, and bytes that it holds at once.
SPLIT, PIECE = 64 << 20, 1 << 20
ROWS = 65_536


@dataclass
class _Range(InputPartition):
    archive: str
    entry: str
    begin: int
    end: int


def _filled_lines(stream) -> Iterator[tuple[int, bytes]]:
    """(place of its first byte, line) of the lines that hold more than white space."""
    place, rest = 0, b""
    while True:
        piece = stream.read(PIECE)
        lines = (rest + piece).split(b"\n")
        rest = lines.pop() if piece else b""
        for line in lines:
            if line.strip():
                yield place, line
            place += len(line) + 1
        if not piece:
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.skip, self.column = int(options.get("skip", 0)), int(options.get("column", 0))
        self.split, self.heads = int(options.get("split", SPLIT)), int(options.get("heads", 0))
        self.subjects = {x for x in options.get("subjects", "").split(",") if x}

    def partitions(self) -> list[_Range]:
        out = []
        for archive in sorted(glob.glob(self.path)):
            if self.subjects and _subject(archive) not in self.subjects:
                continue
            with zipfile.ZipFile(archive) as z:
                for entry in sorted({i.filename: i for i in z.infolist() if i.filename.endswith(self.suffix) and not i.is_dir()}.values(), key=lambda i: i.filename):
                    step = max(entry.file_size, 1) if self.heads else self.split
                    out += [_Range(archive, entry.filename, at, min(at + step, entry.file_size)) for at in range(0, entry.file_size, step)]
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there is nothing to read
            return
        subject = _subject(partition.archive)
        with zipfile.ZipFile(partition.archive) as z, z.open(partition.entry) as stream:
            lines = _filled_lines(stream)
            if self.heads:
                first = [line.decode("utf-8", "replace").strip() for _, (_, line) in zip(range(self.heads), lines, strict=False)]
                yield pa.RecordBatch.from_pydict({"subject": [subject], "entry": [partition.entry], "lines": [first]}, _HEADS)
                return
            ids, values = [], []
            for n, (place, line) in enumerate(lines):
                if place >= partition.end:
                    break
                if place >= partition.begin and n >= self.skip:
                    ids.append(n - self.skip)
                    values.append(_number(line, self.column))
                if len(ids) == ROWS:
                    yield self._batch(subject, partition.entry, ids, values)
                    ids, values = [], []
            if ids:
                yield self._batch(subject, partition.entry, ids, values)

    def _batch(self, subject: str, entry: str, ids: list, values: list) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([subject] * n), pa.array([entry] * n), pa.array(ids, pa.int64()), pa.array(values, pa.float64())], schema=_SAMPLES)


_SAMPLES = pa.schema([("subject", pa.string()), ("entry", pa.string()), ("idx", pa.int64()), ("value", pa.float64())])
_HEADS = pa.schema([("subject", pa.string()), ("entry", pa.string()), ("lines", pa.list_(pa.string()))])


def _subject(archive: str) -> str:
    return os.path.basename(archive).rpartition(".")[0]


def _number(line: bytes, column: int) -> float | None:
    cells = line.split(b",")
    try:
        return float(cells[column])
    except (ValueError, IndexError):
        return None


class ArchiveSource(DataSource):
    """spark.read.format("signal_archive"); see archive_samples() and archive_heads() for its options."""

    @classmethod
    def name(cls) -> str:
        return "signal_archive"

    def schema(self) -> str:
        return "subject string, entry string, lines array<string>" if self.options.get("heads") else "subject string, entry string, idx long, value double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _source(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("signal_archive").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def archive_samples(spark: SparkSession, path: str, suffix: str, skip: int = 1, column: int = 0, split: int = SPLIT, subjects: list[str] | None = None) -> DataFrame:
    """(subject, entry, idx, value) of all entries that end with suffix in the zip archives of a glob, one archive a subject.

    An entry of more than `split` bytes is read by several tasks: each goes through the entry from its start, as compressed
    bytes have no middle, and gives the samples whose lines begin in its range. idx counts filled lines behind the first
    `skip`, so it holds across splits; value is the number in a line's column, null if there is none. Only archives of
    `subjects` are listed, if given. The archives must be where Python on every executor can open them (a mounted store);
    recordings.unzip reads those that only Spark reaches."""
    return _source(spark, path, suffix=suffix, skip=skip, column=column, split=split, subjects=",".join(subjects or []))


def archive_heads(spark: SparkSession, path: str, suffix: str, lines: int = 2, subjects: list[str] | None = None) -> DataFrame:
    """(subject, entry, lines): the first filled lines of each entry."""
    return _source(spark, path, suffix=suffix, heads=lines, subjects=",".join(subjects or []))


def session_starts(spark: SparkSession, path: str, suffix: str = "BVP.csv", rate: float = 64.0) -> DataFrame:
    """(subject, entry, start, reason): when each session begins, in epoch seconds from its first line, and why it can't be used
    (`no start`, `wrong rate`), or null."""
    head = archive_heads(spark, path, suffix).select("subject", "entry", F.get("lines", F.lit(0)).try_cast("double").alias("start"), F.get("lines", F.lit(1)).try_cast("double").alias("fs"))
    reason = F.when(F.col("start").isNull(), "no start").when(F.col("fs").isNull() | (F.abs(F.col("fs") - rate) > 1e-6), "wrong rate")
    return head.select("subject", "entry", "start", reason.alias("reason"))
