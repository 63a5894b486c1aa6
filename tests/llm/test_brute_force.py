"""Predictions and page texts against plain computations that share no step with the operators."""

import re
import zlib

import numpy as np
import pandas as pd

from rillwork.llm import html_text, language_id


def vector(text):
    """The bundle of a text's trigram vectors, a letter at a time."""
    symbol, letters = language_id._symbols(), np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (64, 1024)).astype(int)
    line = [0]
    for c in text:
        s = int(symbol[ord(c)])
        if s or line[-1]:
            line.append(s)
    line += [0] if line[-1] else []
    out = np.zeros(1024)
    for a, b, c in zip(line, line[1:], line[2:]):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out, max(len(line) - 2, 1), any(line)


def test_languages_equal_plain_cosines(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    sums: dict[str, np.ndarray] = {}
    vectors = {}
    for d in docs.itertuples():
        v, n, letters = vectors[d.doc_id] = vector(d.text or "")
        if zlib.crc32(str(d.doc_id).encode()) % 3 != 1 and d.text is not None and d.lang is not None and letters:
            sums[d.lang] = sums.get(d.lang, 0) + v / n
    langs = sorted(sums)
    matrix = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    got = {r["doc_id"]: r for r in language_id.op6_language_id(spark, sf).collect()}
    right = held = 0
    for d in docs.itertuples():
        v, _, letters = vectors[d.doc_id]
        cosine, r = matrix @ (v / max(np.linalg.norm(v), 1e-9)), got[d.doc_id]
        assert r["held_out"] == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        if not letters:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best = np.sort(cosine)
        assert abs(r["score"] - min(1, max(0, best[-1]))) < 1e-4
        assert r["lang_pred"] == langs[int(cosine.argmax())] or best[-1] - best[-2] < 1e-4
        held += r["held_out"]
        right += r["held_out"] and r["lang_pred"] == d.lang
    assert held > 30 and right >= 0.97 * held


def test_page_texts_equal_an_article_by_patterns(spark, sf):
    """On pages whose parts are named by elements: what stands in the article, cut out with regular expressions alone."""
    import html

    def plain(page):
        page = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|iframe|title)\b.*?</\1\s*>", "", page or "")
        found = re.search(r"(?is)<article\b[^>]*>(.*?)</article>", page)
        if not found or re.search(r"(?is)<(nav|aside|form|footer|div|section|table|button|select)\b", found[1]):
            return None
        parts = re.split(r"(?is)</?(?:p|h[1-6]|ul|ol|li|blockquote|pre|header|figure|figcaption|dl|dt|dd|hr)\b[^>]*>", found[1])
        texts = [" ".join(html.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)<br\b[^>]*>", " ", x))).split()) for x in parts]
        return "\n\n".join(t for t in texts if t)

    pages = pd.read_parquet(f"{sf}/pages.parquet")
    want = {p.page_id: plain(p.html) for p in pages.itertuples()}
    simple = {i: t for i, t in want.items() if t is not None}
    got = {r["page_id"]: r["text"] for r in html_text.op2_html_extraction(spark, sf).collect()}
    assert len(simple) >= 5 and {i: got[i] for i in simple} == simple
