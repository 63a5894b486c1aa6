"""Best-fit packing of tokenised documents with swap-based local search."""

from __future__ import annotations

import bisect
import random
import re
import zlib
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.store import cut, table

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together.
GROUP = 16_384
#: Entries that a task's two tables of encoded strings may hold before one is emptied, and their longest string.
WORDS, LONGEST = 500_000, 64
#: Entries of each that outlive the task, the first ones: frequent strings come early.
KEPT = 30_000
#: What lies between white space and is sure to be cut by _PARTS as by the vocabulary: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the vocabulary's own pattern for pre-tokens, for such strings in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary drops white space before it merges, so each string between ASCII white space is encoded alone and
    remembered, and so are the pre-tokens of plain ones, which go to the library's merges directly, their bytes
    spelled as the vocabulary spells them. All ids come from the library. Of the tables little outlives a task: a worker lives on
    through other stages, which need its memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge, self.strings, self.parts = tokenizer.encode, tokenizer.model.tokenize, {}, {}
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves
        other = iter(range(256, 512))
        self.spelled = [chr(b if b in shown else next(other)) for b in range(256)]

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            spelled = word if word.isascii() else "".join([self.spelled[b] for b in word.encode()])
            found = np.array([t.id for t in self.merge(spelled)], "<u4").tobytes()
            if len(word) <= LONGEST:
                if len(self.parts) >= WORDS:
                    self.parts.clear()
                self.parts[word] = found
        return found

    def missing(self, string: str) -> bytes:
        if _PLAIN.fullmatch(string) and "<|" not in string:
            ids = b"".join(map(self.part, _PARTS.findall(string.lower())))
        else:
            ids = self.ids(string) if string else b""
        if len(string) <= LONGEST:
            if len(self.strings) >= WORDS:
                self.strings.clear()
            self.strings[string] = ids
        return ids

    def forget(self) -> None:
        self.strings, self.parts = (dict(islice(x.items(), KEPT)) for x in (self.strings, self.parts))

    def __call__(self, text: str) -> bytes:
        get, missing = self.strings.get, self.missing
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        return b"".join([x if (x := get(w)) is not None else missing(w) for w in text.split(" ")])


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(batches, tokenizer: str, capacity: int, end_id: int):
    encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
    try:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
    finally:
        encoder.forget()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than
    the capacity; a null text is empty."""

    def run(batches):
        yield from _pieces(batches, tokenizer, capacity, end_id)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes by bin: longest first, each into the fullest bin that still has room."""
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # rooms in use, ascending
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = bisect.bisect_left(rooms, lengths[i])
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - lengths[i]:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int, rounds: int = 50, width: int = 64) -> list[list[int]]:
    """Empties underfull bins: moves one piece, or exchanges one for one or two for one, between two of them while
    the sum of squared fills grows. A move out of the emptier bin grows it whenever the target has room, an exchange
    whenever the fuller bin ends fuller. Each pass takes the `width` emptiest bins as givers; it ends when a pass
    changes nothing. The search is deterministic."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    rng = random.Random(7)
    for _ in range(rounds):
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        if len(open_bins) < 2 or sum(fill[b] for b in open_bins) > capacity * (len(open_bins) - 1):
            break  # no bin can be saved
        changed = False
        for giver in open_bins[:width]:
            takers = [b for b in open_bins if b != giver and fill[b] >= fill[giver] and fill[b] < capacity]
            rng.shuffle(takers)
            for taker in takers[: 4 * width]:
                if not bins[giver]:
                    break
                room = capacity - fill[taker]
                best = None  # (gain in the taker, given, returned)
                mine = sorted(bins[giver], key=lambda i: lengths[i])
                sizes = [lengths[i] for i in mine]
                k = bisect.bisect_right(sizes, room)
                if k:
                    best = (sizes[k - 1], (mine[k - 1],), ())
                for back in bins[taker]:
                    k = bisect.bisect_right(sizes, room + lengths[back]) - 1
                    if k >= 0 and (gain := sizes[k] - lengths[back]) > (best[0] if best else 0):
                        best = (gain, (mine[k],), (back,))
                    lo, hi = 0, len(mine) - 1
                    while lo < hi:  # two pieces for one
                        both = sizes[lo] + sizes[hi]
                        if both > room + lengths[back]:
                            hi -= 1
                        else:
                            if (gain := both - lengths[back]) > (best[0] if best else 0):
                                best = (gain, (mine[lo], mine[hi]), (back,))
                            lo += 1
                if best and best[0] > 0:
                    gain, given, returned = best
                    bins[giver] = [i for i in bins[giver] if i not in given] + list(returned)
                    bins[taker] = [i for i in bins[taker] if i not in returned] + list(given)
                    fill[giver] -= gain
                    fill[taker] += gain
                    changed = True
        if not changed:
            break
    return [b for b in bins if b]


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"


def _pack(parts: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Packs pieces by group; group is a hash of the piece, so that each has about the same number."""

    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        number, offset, used = np.zeros((3, len(lengths)), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = b, at
                at += lengths[i]
            used[members] = at
        return pdf.drop(columns="g").assign(bin=number + (int(key[0]) << 32), offset=offset, used=used)

    dealt = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, _PACKED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text).

    A piece of full capacity is a sequence of its own. The others are dealt by a hash into groups of about `group`,
    so that no task holds more, and each group is packed best fit, longest first, then improved by swaps. What lies
    in bins that are less than 98 percent full is taken out and packed once more, with that of other groups, so the
    groups cost next to no sequences. A null or empty text is a piece of the end id alone; rows that repeat are
    packed each on its own; an empty table gives no rows; other columns are left alone. A null doc_id is kept.
    """
    cutout = cut(pieces(docs, tokenizer, capacity, end_id))
    n = cutout.where(F.col("length") < capacity).count()
    full = cutout.where(F.col("length") == capacity)
    first = cut(_pack(cutout.where(F.col("length") < capacity), max(1, round(n / group)), capacity))
    loose = F.col("used") < 0.98 * capacity
    rest = first.where(loose)
    again = _pack(rest.select("doc_id", "piece", "start", "length", "ids_crc32"), max(1, round(rest.count() / group)), capacity)
    base = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = full.select(*base, (F.monotonically_increasing_id() * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = first.where(~loose).select(*base, (F.col("bin") * 4 + 1).alias("sequence_id"), "offset")
    return alone.unionByName(packed).unionByName(again.select(*base, (F.col("bin") * 4 + 2).alias("sequence_id"), "offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what is left becomes sequences."""
    return pack(docs, default_tokenizer())
