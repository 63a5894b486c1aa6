"""Main text of web pages by site style trees."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.store import BROADCAST_IDS, cut, table
from rillwork.llm.text import per_batch

#: A site's node is judged once this many of its different pages have it; below LEAST importance it goes.
PAGES, LEAST = 4, 0.3
#: Weight of a node's own content against the presentation of the node around it.
CONTENT = 0.9

# Elements by what browsers do with them.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "legend", "li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Elements, roles and words in class or id that mark what isn't article text.
_ASIDE = set("head nav header footer aside form button select option datalist dialog menu label fieldset search object audio video canvas map".split())
_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored promo promotion banner masthead header footer nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus discussion form search pagination pager toolbar widget skip copyright".split()
)
#: Of these, words that layouts also give to what holds an article: an article or main element inside undoes them.
_LAYOUT = set("header masthead sidebar aside rail nav navbar navigation menu search skip toolbar widget footer banner".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 b i em strong a span u s small mark sub sup code q cite abbr blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption br".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Words that say nothing of what an element holds, and words ahead of what an element has or lacks.
_NEUTRAL = set("site page main global post posts entry article message messages user inner outer wrap wrapper box container content area block section list item items row col group body bar top bottom left right center sticky fixed mobile desktop primary secondary js id no text link links button icon image slot unit zone space holder panel form button text thread count title heading".split())
_NEGATED = set("no has have with without not hide show is".split())
_SPLIT, _HUMP = re.compile(r"[^a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Depth from which paths don't grow any more, so that very deep pages cost no more for an element.
DEEP = 128


class Block(NamedTuple):
    path: str
    text: str
    aside: bool  # by its markup
    prose: bool  # only prose elements without class or id stand between it and its article
    article: bool


class _Open(NamedTuple):
    tag: str
    path: str
    aside: int  # 0 no, 1 by words that an article undoes, 2 for good
    prose: bool
    article: bool


@lru_cache(1 << 16)
def _marks(value: str) -> frozenset[str]:
    """Marking words of class names and ids, by their last word that says something: `reader-comments`, `ad-300x250` and
    `notice-box` are marked, `notice-board` isn't, nor is `has-sidebar`. Of a name of marking and neutral words alone
    every marking word counts."""
    found: set[str] = set()
    for name in _HUMP.sub("-", value).lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        if words and words[0] in _NEGATED:
            continue
        if set(words) <= _WORDS | _NEUTRAL:
            found |= set(words) & _WORDS
        while words and (words[-1] in _NEUTRAL or len(words[-1]) == 1):
            words.pop()
        found |= set(words[-1:]) & _WORDS
    return frozenset(found)


def _attributes(text: str, tag: str, article: bool) -> tuple[str, int]:
    """What the path shows of an element's attributes, and how they mark it as no article text (see _Open)."""
    label, aside = "", 0
    for name, *values in _ATTR.findall(text):
        name, raw = name.lower(), next((v for v in values if v), "")
        value = raw.lower()
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + " ".join(re.sub(r"\d+", "9", value).split())
            if tag not in ("html", "body"):
                found = _marks(raw) - ({"header"} if article else set())
                aside = max(aside, 2 if found - _LAYOUT else 1 if found else 0)
        elif name == "role":
            aside = 2 if value.strip() in _ROLES else aside
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            aside = 2
    return label, aside


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with the path of tags, classes and ids that leads to each.

    White space is one space, character references are decoded, empty blocks left out. Tags may be unclosed, crossed
    or in any case; a comment, script or style that doesn't end runs to the end of the page."""
    stack, out, words, at, n = [_Open("", "", 0, False, False)], [], [], 0, len(page)

    def flush() -> None:
        if words:
            if text := " ".join(html.unescape("".join(words)).split()):
                e = stack[-1]
                k = len(stack) - 1
                while k > 0 and stack[k].tag not in _BLOCK:
                    k -= 1
                out.append(Block(stack[k].path, text, e.aside > 0, e.prose, e.article))
            words.clear()

    def close(k: int) -> None:
        """Ends the element at depth k and all in it."""
        if any(e.tag in _BLOCK or e.aside != stack[k - 1].aside for e in stack[k:]):
            flush()
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k and (tag in _BLOCK or not any(e.tag in _BLOCK for e in stack[k + 1 :])):
                close(k)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at) if not m[3].rstrip().endswith("/") else None
            if end:
                at = page.find(">", end.start()) + 1 or n
            elif not m[3].rstrip().endswith("/"):
                at = n
            continue
        if tag in _VOID:
            if tag == "br" or tag == "wbr":
                words.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _SIBLINGS:
            low = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _BOUNDS[tag]:
                    break
                if stack[k].tag in _SIBLINGS[tag]:
                    low = k
            if low:
                close(low)
        up = stack[-1]
        label, marked = _attributes(m[3], tag, up.article) if m[3] else ("", 0)
        article = up.article or tag in ("article", "main")
        if article and not up.article and up.aside == 1:
            aside = marked
        else:
            aside = max(up.aside, marked, 2 if tag in _ASIDE and not (tag == "header" and up.article) else 0)
        prose = article and (tag in ("article", "main") or (up.prose and tag in _PROSE and not label))
        if tag in _BLOCK or aside != up.aside:
            flush()
        stack.append(_Open(tag, f"{up.path}/{tag}{label}" if (tag in _BLOCK or label) and len(stack) < DEEP else up.path, aside, prose, article))
    flush()
    return out


def _key(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - 2**63


def _nodes(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n): in how many different pages of the host the node has the feature. Kind 0 is the node
    itself, 1 a text in it (content), 2 the form in which its blocks follow each other (presentation). Pages with the same
    blocks count once, so copies of a page don't make its text a site's furniture."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: set[tuple] = set()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host is None or not page:
                continue
            around: dict[int, list[str]] = {}
            found = blocks_of(page)
            k = _key("\n".join(f"{b.path}\t{b.text}" for b in found))
            for b in found:
                path, parent = _key(b.path), b.path.rpartition("/")
                rows.add((k, host, path, 0, 0))
                rows.add((k, host, path, 1, _key(b.text)))
                around.setdefault(_key(parent[0]), []).append(parent[2])
            for path, children in around.items():
                rows.add((k, host, path, 0, 0))
                rows.add((k, host, path, 2, _key(" ".join(x for i, x in enumerate(children) if not i or x != children[i - 1]))))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page", "host", "path", "kind", "feature"])

    seen = pages.select("host", "html").mapInArrow(per_batch(run), "page long, host string, path long, kind long, feature long").distinct()
    return seen.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))


def site_style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, content, presentation, importance) of each node of each host's merged page trees.

    With m pages that have the node: content importance is 1 less the mean entropy of its texts, where a text on k of
    m pages has entropy log k / log m; presentation importance is the entropy of its forms over the pages to base m.
    importance is their weighted mean. Both lie in 0 to 1; a node that every page repeats has 0."""
    counted = _nodes(pages)
    having = counted.where(f"kind = 0 and n >= {PAGES}").select("host", "path", F.col("n").alias("m"))
    seen = counted.where("kind > 0").join(having, ["host", "path"])
    entropy = F.when(F.col("kind") == 1, F.log("n") / F.log("m")).otherwise(-F.col("n") / F.col("m") * F.log(F.col("n") / F.col("m")) / F.log("m"))
    seen = seen.withColumn("h", entropy)
    each = seen.groupBy("host", "path").agg(F.max("m").alias("pages"), (1 - F.avg(F.when(F.col("kind") == 1, F.col("h")))).alias("content"), F.sum(F.when(F.col("kind") == 2, F.col("h"))).alias("presentation"))
    return each.withColumn("importance", F.coalesce(CONTENT * F.col("content") + (1 - CONTENT) * F.coalesce("presentation", F.lit(0.0)), F.col("presentation")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_removed for each row of pages (page_id, url, html).

    1. The trees of a host's pages are merged into one style tree; each node that PAGES different pages have gets its
       importance, so a host of fewer pages is judged by markup alone. Elements more than DEEP levels down count to
       the node above them.
    2. From each page go the branches that its markup marks as menus, headers, footers, sidebars, notices, adverts,
       forms or comments, and those whose node is unimportant on the host. Prose that stands in an article or main
       element without a box of its own is never unimportant; a page that would lose all its text by importance
       keeps it, and equal pages count once, so pages that repeat lose nothing.
    3. Where a page has article or main elements, what stands outside them goes.
    Blocks left are joined by two line feeds; nothing is cut off. A null or empty html, or one without text, gives an
    empty text. A null or odd url has no host, and its page is judged by its markup alone. Rows that repeat are kept;
    an empty table gives no rows; other columns are left alone.
    """
    named = pages.select("page_id", "url", "html", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host")).withColumn("host", F.expr("nullif(host, '')"))
    noise = cut(site_style_tree(named).where(f"content is not null and importance < {LEAST}").select("host", "path"))
    by_host = noise.groupBy("host").agg(F.collect_set("path").alias("noise"))
    by_host = F.broadcast(by_host) if noise.count() <= BROADCAST_IDS else by_host
    joined = named.join(by_host, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, gone = [], [], []
        for page, noise in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist(), strict=True):
            found, low = blocks_of(page or ""), set(noise or ())
            inside = any(b.article and not b.aside for b in found)
            marked = [b for b in found if not b.aside and (b.article or not inside)]
            kept = [b.text for b in marked if b.prose or not low or _key(b.path) not in low] or [b.text for b in marked]
            texts.append("\n\n".join(kept))
            total.append(len(found))
            gone.append(len(found) - len(kept))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_removed"])

    return joined.select("page_id", "url", "html", "noise").mapInArrow(per_batch(run), "page_id long, url string, text string, n_chars long, n_blocks long, n_removed long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
