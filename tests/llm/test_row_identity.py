"""Rows are judged by id and text, and columns of any name come through every stage as they were."""

import collections
import random

import corpus_pipeline
from rillwork.llm import html_text, line_dedup, near_dedup, passage_dedup

r = random.Random(23)
WORDS = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    one = random.Random(seed)
    return " ".join(one.choice(WORDS) for _ in range(n))


def test_lines_of_rows_that_share_an_id(spark):
    a, b, c, d = (prose(9, i) for i in range(4))
    rows = [(1, a), (2, f"{a}\n{b}"), (2, f"{c}\n{d}"), (2, f"{c}\n{d}"), (None, f"{b}\n{prose(9, 7)}"), (None, prose(9, 8)), (None, None), (3, f"{d}\n{prose(9, 9)}")]
    got = line_dedup.dedup_lines(spark.createDataFrame([(*x, 5, 6) for x in rows], "doc_id long, text string, gone int, n_lines int")).collect()
    found = collections.Counter((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"], x["gone"]) for x in got)
    # null ids come first, so their lines stay; of rows that share an id each loses its own repeats only, equal rows count together
    assert found == collections.Counter([(1, a, 1, 0, 5), (2, "", 2, 2, 5), (2, f"{c}\n{d}", 4, 0, 5), (2, f"{c}\n{d}", 4, 0, 5), (None, f"{b}\n{prose(9, 7)}", 2, 0, 5), (None, prose(9, 8), 1, 0, 5), (None, None, 0, 0, 5), (3, prose(9, 9), 2, 1, 5)])


def test_stages_carry_clashing_columns(spark, tmp_path):
    """Nulls, repeated rows, rows that share an id and columns that stages use names of: nothing is lost or overwritten."""
    item = prose(40, 900)
    rows = [(i, prose(60, i)) for i in range(6)] + [(2, prose(60, 50)), (2, prose(60, 50)), (None, prose(60, 51)), (None, prose(60, 52)), (9, None), (10, ""), (11, f"{prose(9, 1)} {item}")]
    names = ["_id", "_text", "n_lines", "n_dropped", "gone", "lang_pred", "score", "text_id", "key", "piece"]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    made = [(i, t, "en", None if t is None else len(t), *range(k, k + len(names))) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = collections.Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        found = collections.Counter(map(tuple, got.collect()))
        lost = whole - found
        assert found <= whole, name
        want = {"language_id": {9, 10}, "decontamination": {11}}.get(name, set())
        assert {x[0] for x in lost} == want and sum(lost.values()) == len(want), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(rows)
    assert near_dedup.one_of_each(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_passages_go_from_the_text_they_were_found_in(spark):
    passage = prose(60, 70)
    rows = [(1, f"{prose(80, 1)} {passage} {prose(80, 2)}"), (2, f"{prose(80, 3)} {passage} {prose(80, 4)}"), (2, prose(200, 5)), (3, prose(200, 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passage_dedup.without_passages(docs, passage_dedup.repeated_passages(docs)).collect()
    texts = collections.Counter((x["doc_id"], x["text"]) for x in got)
    assert texts[1, rows[0][1]] == texts[2, rows[2][1]] == texts[3, rows[3][1]] == 1
    assert min(len(x["text"]) for x in got if x["doc_id"] == 2) < len(rows[1][1]) - 0.4 * len(passage)


def test_planted_passages_are_found(spark):
    """Passages in running text, in two documents each: nearly all of 50 words and more, most of 40, and nothing else."""
    rows, spans = [], {}
    for n in (40, 50, 60, 100):
        for k in range(50):
            inside = prose(n, 1000 * n + k)
            for half in range(2):
                at = len(rows)
                before, behind = prose(60 + (7 * k) % 90, 10_000 + at), prose(60 + (11 * k) % 90, 20_000 + at)
                rows.append((at, f"{before} {inside} {behind}"))
                spans[at] = n, len(before) + 1, len(before) + 1 + len(inside)
    rows += [(len(rows) + i, prose(150, 900_000 + i)) for i in range(50)]
    line = prose(20, 77)
    rows += [(len(rows) + i, f"{prose(30, 910_000 + i)}\n{line}\n{prose(30, 920_000 + i)}") for i in range(8)]
    found = collections.Counter()
    for x in passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n, lo, hi = spans[x["doc_id"]]  # no clean document, none that only a line repeats in
        assert x["start"] >= lo - 120 and x["start"] + x["length"] <= hi + 120
        found[n, x["doc_id"]] += x["n_words"]
    share = {n: sum(k[0] == n for k in found) / 100 for n in (40, 50, 60, 100)}
    assert share[40] >= 0.7 and min(share[n] for n in (50, 60, 100)) >= 0.94


def test_compound_class_names_mark_boxes(spark):
    """Boxes inside an article go by the word that says what they are, on hosts without a tree too."""
    gone = ["reader-comments", "wp-block-comments", "ad-300x250", "cookie-message", "site-wide-banner", "elementor-widget-sidebar", "jp-related-posts", "readerComments", "notice-box", "post-share"]
    stay = ["notice-board", "has-sidebar", "long-form", "form-guide", "price-list", "story", "content no-sidebar", "x9"]
    inside = "".join(f"<div class='{c}'>{c} text</div>" for c in [*gone, *stay])
    df = spark.createDataFrame([(1, "http://one.example/", f"<article><p>first</p>{inside}<p>last</p></article>")], "page_id long, url string, html string")
    assert html_text.main_text(df).first()["text"] == "\n\n".join(["first", *[f"{c} text" for c in stay], "last"])
