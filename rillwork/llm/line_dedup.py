"""Near-duplicate lines by a deletion-neighbourhood join; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm.store import BROADCAST_IDS, cut, fresh, keep, semi, table

#: Lines shorter than this many characters must be equal; from here on one edit is allowed.
NEAR_FROM = 12
#: Parts in which two long lines are compared before variants are emitted.
PARTS = 16


def _spaced(text: str) -> str:
    """SQL for a text whose tabs and other white space but line feeds are spaces; untouched where it has none."""
    for c in ("\\t", "\\r", "\\f", "\\u000b"):
        text = f"replace({text}, '{c}', ' ')"
    return text


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, line_no, line, line_id) of lines that aren't blank; tabs and the like count as spaces, those at the
    ends are cut off. line_id is a 64-bit hash of the line."""
    split = docs.select("doc_id", "text_id", F.posexplode(F.split(F.expr(_spaced("text")), "\n")).alias("line_no", "line"))
    clean = split.select("doc_id", "text_id", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line"))
    return clean.where("line <> ''").withColumn("line_id", F.xxhash64("line"))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, line_no, line_id, keys): what all but the last steps need of a line; keys are those of _pieces() for two
    parts, null for a line that must be equal."""
    lines = lines_of(docs).withColumn("n", F.length("line"))
    key = "xxhash64({m}, {part}, {text})"
    parts = [key.format(m=m, part=0, text=f"right(line, {m} - {m} div 2)") + ", " + key.format(m=m, part=1, text=f"left(line, cast({m} div 2 as int))") for m in ("n", "(n - 1)")]
    keys = F.when(F.col("n") >= NEAR_FROM, F.expr(f"array({', '.join(parts)})"))
    return lines.select("doc_id", "text_id", "line_no", "line_id", keys.alias("keys"))


def _pieces(lines: DataFrame, parts: int, *keep: str) -> DataFrame:
    """For m = n - 1 and n (n the length) and for every part of a line cut in `parts`: rest, a hash of all outside it.

    m is the length of the shorter line of a pair. If one edit makes two lines equal, all but one part agree: what is
    before it, counted from the front, and what is after it, counted from the back."""
    wide = lines.select(*keep, "line", F.explode(F.expr("array(length(line) - 1, length(line))")).alias("m"))
    wide = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    wide = wide.select("*", F.expr(f"cast(m * part div {parts} as int)").alias("before"), F.expr(f"cast(m - m * (part + 1) div {parts} as int)").alias("after"))
    return wide.withColumn("rest", F.expr("xxhash64(m, part, left(line, before), right(line, after))"))


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that more than one line has; combined before the shuffle, so a hot key is one row from each task."""
    return keys.groupBy("rest").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo <> hi").select("rest")


def _sharing(keys: DataFrame) -> DataFrame:
    shared = cut(_shared(keys))
    return semi(keys, shared, "rest", shared.count())


def later_neighbours(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """line_id of the distinct lines that are one edit away from a line that begins earlier.

    lines: keyed_lines(docs), materialised.

    Two lines are one edit apart if a deletion makes them equal: the same character of both (a substitution) or one
    of the longer (an insertion). A line's variants are emitted only where it can meet another: where two lines agree
    outside a half and then outside a sixteenth of them, which two hash joins find, the variants delete within that
    sixteenth. Lines of one substitution key are all one edit apart, so each is compared with the earliest of them; of
    an insertion key the shorter line is unique. So pairs stay linear in the lines, and each is verified.
    """
    some = cut(_sharing(lines.where("keys is not null").select("line_id", F.explode("keys").alias("rest"))).select("line_id").distinct())
    texts = semi(lines_of(docs), some, "line_id", some.count())
    texts = cut(texts.groupBy("line_id").agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "text_id", "line_no")).alias("first")))
    places = _sharing(_pieces(texts, PARTS, "line_id").select("line_id", "m", "part", "rest"))
    alike = places.drop("rest").join(_pieces(texts, PARTS, "line_id", "first"), ["line_id", "m", "part"])
    alike = alike.select("line_id", "first", "line", "rest", (F.length("line") > F.col("m")).alias("longer"), F.expr("substr(line, before + 1, length(line) - before - after)").alias("mid"))
    alike = cut(alike)
    cuts = alike.select("*", F.explode(F.expr("sequence(0, length(mid))")).alias("i")).where("i > 0")
    variants = cuts.withColumn("left_out", F.expr("concat(left(mid, i - 1), substr(mid, i + 1))"))
    me = F.struct("first", "line_id", "line").alias("me")

    same = cut(variants.where("not longer").select(F.expr("xxhash64(rest, i, left_out)").alias("key"), me))
    earliest = same.groupBy("key").agg(F.min("me").alias("other"), F.max("me").alias("last")).where("other <> last").drop("last")
    swaps = same.join(earliest, "key").where("me <> other")

    shorter = alike.where("not longer").select(F.xxhash64("rest", "mid").alias("key"), me)
    longer = variants.where("longer").select(F.xxhash64("rest", "left_out").alias("key"), F.struct("first", "line_id", "line").alias("other")).distinct()
    pairs = swaps.select("me", "other").unionByName(shorter.join(longer, "key").select("me", "other"))
    near = pairs.where("levenshtein(me.line, other.line, 1) between 0 and 1")
    return near.select(F.greatest("me", "other").getField("line_id").alias("line_id")).distinct()


def _identified(docs: DataFrame, doc: str, text_id: str) -> DataFrame:
    """docs with its rows' identity: doc, the doc_id (a null one before all others), and text_id, a hash of the text where a
    doc_id is null or has different texts, else 0 (so that nothing is shuffled for the many that have one)."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).where("doc_id is not null")
    several = cut(hashed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias(text_id)))
    joined = docs.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "doc_id", "left")
    own = F.when(F.col("doc_id").isNull() | F.col(text_id), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return joined.withColumn(doc, F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(text_id, own)


def _deduped(docs: DataFrame, n_lines: str, n_dropped: str) -> DataFrame:
    """docs with fewer lines, and columns n_lines and n_dropped (names that docs doesn't have)."""
    doc, text_id, numbers, total = fresh(docs, "doc"), fresh(docs, "text_of"), fresh(docs, "gone"), fresh(docs, "total")
    base = _identified(docs, doc, text_id)
    texts = base.select(F.col(doc).alias("doc_id"), F.col(text_id).alias("text_id"), "text")
    lines = keep(keyed_lines(texts))
    later = cut(later_neighbours(lines, texts))
    in_doc = keep(lines.groupBy("line_id", "doc_id", "text_id").agg(F.min("line_no").alias("n"), F.count("*").alias("c")))
    spread = in_doc.groupBy("line_id").agg(F.min(F.struct("doc_id", "text_id")).alias("d"), F.count("*").alias("docs"))
    known = spread.where("docs > 1").select("line_id", "d").join(later.withColumn("near", F.lit(True)), "line_id", "full")
    marks = lines.select("line_id", "doc_id", "text_id", "line_no")
    gone = marks.join(known, "line_id").where("near or doc_id <> d.doc_id or text_id <> d.text_id").unionByName(marks.join(in_doc.where("c > 1").drop("c"), ["line_id", "doc_id", "text_id"]).where("line_no <> n"), allowMissingColumns=True)
    counted = in_doc.groupBy("doc_id", "text_id").agg(F.sum("c").alias(total))
    per_doc = counted.join(gone.groupBy("doc_id", "text_id").agg(F.collect_set("line_no").alias(numbers)), ["doc_id", "text_id"], "left").withColumnsRenamed({"doc_id": doc, "text_id": text_id}).hint("shuffle_hash")
    kept = F.expr(f"filter(split(text, '\\n'), (x, i) -> not array_contains({numbers}, cast(i as bigint)))")
    out = base.join(per_doc, [doc, text_id], "left")
    out = out.withColumn(n_lines, F.coalesce(total, F.lit(0).cast("long"))).withColumn(n_dropped, F.coalesce(F.size(numbers), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*docs.columns, n_lines, n_dropped)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text reduced to the lines that no earlier line repeats, and n_lines and n_dropped.

    A line goes if an equal line, or for lines of 12 characters or more one within one edit, occurs earlier, by
    doc_id and then by place in the text. That the earlier line goes itself makes no difference. White space at a
    line's ends doesn't count; blank lines stay and aren't counted. Other columns are left as they are, but for
    columns named n_lines or n_dropped, which are replaced. A null text stays null with 0 lines, an empty one empty.
    Rows of one doc_id with different texts are judged each, in the order of their texts' hashes; rows that repeat in
    both are one document: each counts all their lines and keeps the same ones. Rows with a null doc_id come first.
    An empty table gives no rows. Everything is Spark's own expressions; keys are 64-bit hashes.
    """
    out = _deduped(docs.drop("n_lines", "n_dropped"), "n_lines", "n_dropped")
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go; a document goes if it had lines and all of them were repeats.

    Rows are judged as in dedup_lines(), by doc_id and text. Null, empty and blank texts have no lines and stay; n_chars
    follows the text; every other column, whatever its name, is left alone; an empty table stays empty."""
    n_lines, n_dropped = fresh(docs, "lines_in"), fresh(docs, "lines_out")
    out = _deduped(docs, n_lines, n_dropped).where((F.col(n_dropped) == 0) | (F.col(n_dropped) < F.col(n_lines)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


ORACLE = r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
l AS (SELECT *, trim(translate(raw, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ') AS line FROM s),
f AS (SELECT line, min(ROW(doc_id, line_no)) AS first, count(*) AS c FROM l WHERE line <> '' GROUP BY line),
v AS (SELECT line, first, length(line) AS n, i, hash(left(line, i - 1) || substr(line, i + 1)) AS h
      FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM f WHERE length(line) >= 12)),
p AS (SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy FROM v a JOIN v b ON a.h = b.h AND a.n = b.n AND a.i = b.i AND a.line <> b.line
      UNION SELECT a.line, b.line, a.first, b.first FROM v a JOIN f b ON a.h = hash(b.line) AND length(b.line) = a.n - 1 AND length(b.line) >= 12
      UNION SELECT b.line, a.line, b.first, a.first FROM v a JOIN f b ON a.h = hash(b.line) AND length(b.line) = a.n - 1 AND length(b.line) >= 12),
g AS (SELECT DISTINCT x AS line FROM p WHERE fy < fx),
k AS (SELECT l.doc_id, l.line_no, l.raw, l.line, l.line <> '' AND (g.line IS NOT NULL OR ROW(l.doc_id, l.line_no) > f.first) AS gone
      FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN g ON g.line = l.line)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(k.raw, chr(10) ORDER BY k.line_no) FILTER (NOT k.gone), '') END AS text,
  count(*) FILTER (k.line <> '') AS n_lines, count(*) FILTER (k.gone) AS n_dropped
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""
