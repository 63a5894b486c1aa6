"""What a Python worker holds stays small: blocks of many short texts, and tables that would outlive their stage."""

import collections
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from rillwork.llm import language_id, packing

r = random.Random(41)
WORDS = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(r.randint(2, 9))) for _ in range(3000)]


def test_many_short_texts_take_little_memory():
    """10,000 short texts of one batch: their counts by trigram, laid out at once, would take 300 MB and more."""
    texts = [" ".join(r.choice(WORDS) for _ in range(8)) for _ in range(10_000)] + [None, "", "12 !", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    language_id._symbols()
    tracemalloc.start()
    some = [(letters, vectors[:3].copy(), vectors[-1].copy()) for letters, vectors in language_id._vectors(batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
    assert sum(len(x[0]) for x in some) == len(texts) and [bool(x) for x in some[-1][0][-4:]] == [False, False, False, True]
    at = 0
    for letters, first, last in some:  # the same sums as trigram by trigram
        for text, vector in zip([*texts[at : at + len(first)], texts[at + len(letters) - 1]], [*first, last], strict=True):
            assert np.array_equal(vector, _plain(text))
        at += len(letters)


def _plain(text):
    of = language_id._symbols()
    signs = [0]
    for c in [of[ord(c)] for c in text or ""] + [0]:
        signs += [c] if c or signs[-1] else []
    out = np.zeros(language_id.DIMENSIONS)
    for (a, b, c), n in collections.Counter(zip(signs, signs[1:], signs[2:])).items():
        out += n * language_id.hypervectors(np.array([(a * language_id.SYMBOLS + b) * language_id.SYMBOLS + c])).astype(float)[0]
    return out


def test_few_encoded_strings_outlive_their_task(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 100)
    path = packing.default_tokenizer()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(WORDS), None])], ["doc_id", "text"])
    encoder = packing._encoder(path)
    whole = encoder.ids(" ".join(WORDS))
    for _ in range(2):  # with empty tables, then with those that the first task left
        got = pa.Table.from_batches(packing._pieces(iter([batch]), path, 4096, 1)).to_pylist()
        assert sum(x["length"] for x in got) == len(whole) // 4 + 2
        assert got[0]["ids_crc32"] == zlib.crc32(whole[: 4 * 4096])
        assert len(encoder.strings) == 100 and len(encoder.parts) == 100
    stopped = packing._pieces(iter([batch, batch]), path, 4096, 1)
    next(stopped)
    assert len(encoder.strings) > 100
    stopped.close()  # a task that ends early
    assert len(encoder.strings) == 100
