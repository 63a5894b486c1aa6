"""Each operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import components, decontaminate, flac, html_text, language_id, line_dedup, linking, media, near_dedup, packing, passage_dedup, quality, text, token_counts

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, line string, label string, _gone int"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, texts, start=0):
    rows = [(start + i, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t), 7, 7, "k", "l", "b", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   ", "\n\n", "one", "one two", "a b c d e", "x " * 3000, "é ü ß 日本語 " * 20, "z" * 50_000, "<|endoftext|> it's", "line\nline\nline"]


def shingles(t):
    w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "")).translate({i: i + 32 for i in range(65, 91)}).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_reachable(n, links):
    comp = list(range(n))
    for _ in range(n):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_near_duplicates_equal_brute_force(spark):
    base = prose(80, 1).split()
    copies = []
    for k in range(14):
        w = list(base)
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        copies.append(" ".join(w))
    texts = [*ODD, *ODD, *copies, copies[3].upper(), prose(30, 2), prose(30, 3), prose(6, 4)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = least_reachable(len(texts), links)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_buckets_of_unlike_texts_lose_no_link(spark):
    """Members that their bucket's hub rejects are still linked with each other."""
    a, b = prose(60, 21).split(), prose(60, 22).split()
    texts = [" ".join(a), " ".join(b), " ".join(b[:-1] + ["q"]), " ".join(a[:-2] + ["r", "s"])]
    items = spark.createDataFrame([(i, 56, [1, 2]) for i in range(4)], "id long, n long, keys array<long>")
    for rare in (False, True):
        got = {r["id"]: r["label"] for r in linking.near_components(linking.bucket_members(items), spark.createDataFrame(list(enumerate(texts)), "id long, text string"), rare=rare).collect()}
        assert got == {0: 0, 3: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("small", [500_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1)]
    want = least_reachable(141, [e for e in edges if None not in e])
    got = {x["node"]: x["label"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for e in edges if None not in e and e[0] != e[1] for n in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_estimates_jaccard():
    a, b = (np.array(sorted(random.Random(s).sample(range(10**9), 600)), np.uint64) for s in (1, 2))
    a, b = text.mix(np.concatenate((a[:400], b[:200]))), text.mix(np.concatenate((a[:400], b[200:400])))
    s = text.circulant(np.concatenate((a, b)), np.array([0, 600, 1200]), 512)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08
    long = text.mix(np.arange(100_000, dtype=np.uint64))
    at = np.array([0, 10, 10, 70_000, 100_000])
    whole = np.concatenate([text.circulant(long[x:y], np.array([0, y - x]), 4) for x, y in zip(at[:-1], at[1:], strict=True)])
    assert (text.circulant(long, at, 4) == whole).all()


def test_decontamination_equals_brute_force(spark):
    items = [prose(n, 50 + n) for n in (3, 5, 9, 15, 40, 59, 120)] + [None, "", prose(40, 90)]
    texts = list(ODD)
    for i, q in enumerate(items):
        if q:
            w = q.split()
            texts += [prose(700 + i, i) + " " + q + " " + prose(900, i + 1), prose(50, i) + "\n" + " ".join(w[: len(w) * 4 // 5]), " ".join(w[: len(w) // 2])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if (s := shingles(q)) and 100 * len(s & shingles(t)) >= 75 * len(s)}
    for block in (20_000, 3):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs(spark, texts), bench, block=block).collect()}
        assert got == want and len(want) > 10
    assert decontaminate.contained(docs(spark, []), bench).count() == 0
    assert decontaminate.contained(docs(spark, texts), bench.limit(0)).count() == 0


def edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if not (prev := row) else [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return row[-1]


def test_lines_equal_brute_force(spark):
    base = "the quick brown fox jumps over"
    lines = [base, base, base[:-1], base[1:], base[:9] + "X" + base[10:], base[:9] + "Y" + base[10:], "x" + base, base + "é", "short", "shorT", "short", "", "  ", base + "\t", "e" * 12, "e" * 13, "e" * 14]
    texts = [*ODD] + ["\n".join(rng.sample(lines, 6)) for _ in range(12)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    seen = []
    for d, t in enumerate(texts):
        kept, n, gone = [], 0, 0
        for raw in (t or "").split("\n") if t is not None else []:
            line = raw.replace("\t", " ").replace("\r", " ").replace("\f", " ").replace("\x0b", " ").strip(" ")
            if not line:
                kept.append(raw)
                continue
            n += 1
            near = any(o == line or (min(len(o), len(line)) >= 12 and len(line) < 200 and edit(o, line) <= 1) for o in seen)
            gone += near
            if not near:
                kept.append(raw)
            seen.append(line)
        assert (got[d]["text"], got[d]["n_lines"], got[d]["n_dropped"]) == (None if t is None else "\n".join(kept), n, gone), (d, t)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert set(docs(spark, []).columns) < set(line_dedup.dedup_lines(docs(spark, [])).columns)


def test_lines_run_without_python(spark):
    plan = line_dedup.dedup_lines(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_passages(spark):
    passage = prose(70, 77)
    texts = [*ODD, *[f"{prose(40 + i, 200 + i)} {passage} {prose(30 + i, 300 + i)}" for i in range(5)], prose(150, 400), prose(150, 401)]
    d = docs(spark, texts)
    found = passage_dedup.repeated_passages(d).cache()
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append(r)
    first = len(ODD)
    assert set(got) == set(range(first, first + 5))
    for i in range(first, first + 5):
        covered = sum(r["n_words"] for r in got[i])
        gone = sum(r["n_words"] for r in got[i] if r["removed"])
        assert covered >= 35 and (gone >= 35 if i > first else gone == 0)
        assert all(min(j for j in got for x in got[j] if x["cluster_id"] == r["cluster_id"]) == i for r in got[i] if not r["removed"])
        spans = [texts[i][r["start"] : r["start"] + r["length"]].split() for r in got[i]]
        assert all(sum(w in passage.split() for w in s) >= 0.8 * len(s) for s in spans)
    clean = {r["doc_id"]: r["text"] for r in passage_dedup.without_passages(d, found).collect()}
    assert clean[first] == texts[first] and all(len(clean[i]) < len(texts[i]) for i in range(first + 1, first + 5))
    assert passage_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_passages_of_one_repeated_phrase(spark):
    """Equal shingle sets are linked however often each of them occurs."""
    texts = ["so " * 30, "so " * 90]
    assert shingles(texts[0]) == shingles(texts[1])
    got = passage_dedup.repeated_passages(docs(spark, texts)).collect()
    assert {(r["doc_id"], r["removed"]) for r in got} == {(0, False), (1, True)}


def test_passages_of_short_lines(spark):
    """A list or verse with lines of a few words each is found; every word of a text of six or more is in a paragraph."""
    words = prose(90, 78).split()
    verse = "\n".join(" ".join(words[i : i + 3]) for i in range(0, 90, 3))
    texts = [f"{prose(50 + i, 700 + i)}\n{prose(i, 720 + i)}\n{verse}\n{prose(40, 710 + i)}" for i in range(3)]
    got = collections.Counter()
    for r in passage_dedup.repeated_passages(docs(spark, texts)).collect():
        got[r["doc_id"]] += r["n_words"]
        assert r["removed"] == (r["doc_id"] > 0)
    assert all(60 <= got[i] <= 100 for i in range(3))
    r = random.Random(9)
    for _ in range(200):
        parts = ["".join(r.choice(WORDS) + r.choice(" \n  ") for _ in range(r.randint(0, 60))) for _ in range(3)]
        data = [p.encode() for p in parts]
        first, last = passage_dedup._paragraphs(passage_dedup.Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])))
        sizes = [len(p.split()) for p in parts]
        assert sum(last - first) == sum(sizes) and sum(last - first < 6) == sum(0 < n < 6 for n in sizes)


def test_passages_link_like_brute_force(spark):
    """Of all pairs of paragraphs that are alike enough nearly all are linked, over copies with one to three edits."""
    r = random.Random(17)
    texts = []
    for k in range(60):
        w = prose(110, 1500 + k).split()
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for at in r.sample(range(len(v)), r.randint(2, 6)):
                v[at] = r.choice(WORDS)
            texts.append(" ".join(v))
    d = docs(spark, texts).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    found = [(x["id"], " ".join(texts[x["doc_id"]].split()[x["w0"] : x["w1"]])) for x in passage_dedup.paragraphs_of(d).collect()]
    assert all(texts[x["doc_id"]][x["c0"] : x["c1"]] == " ".join(texts[x["doc_id"]].split()[x["w0"] : x["w1"]]) for x in passage_dedup.paragraphs_of(d).collect())
    sets = {i: shingles(t) for i, t in found}
    ids = sorted(sets)
    alike = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    members = passage_dedup.keep(passage_dedup.bucket_members(d))
    texts_of = passage_dedup.keep(passage_dedup._texts(d, members.select("id")))
    sized = members.join(texts_of.select("id", "n"), "id").join(texts_of.select(F.col("id").alias("hub"), F.col("n").alias("nh")), "hub")
    label = {x["id"]: x["label"] for x in linking.near_components(passage_dedup.keep(sized), texts_of.select("id", "text"), rare=True).collect()}
    linked = [label.get(a, a) == label.get(b, b) for a, b in alike]
    assert len(alike) > 60 and sum(linked) >= 0.97 * len(linked)
    whole = {i: least for i, least in zip(ids, least_reachable(len(ids), [(ids.index(a), ids.index(b)) for a, b in alike]), strict=True)}
    assert all(whole[a] == whole[label[a]] for a in label)  # and none that aren't


def test_passages_of_repeated_rows_and_shared_ids(spark):
    passage = prose(70, 77)
    row = lambda i, k: (i, f"{prose(30, 800 + k)} {passage} {prose(30, 820 + k)}")
    d = spark.createDataFrame([row(1, 1), row(1, 1), row(2, 2), row(2, 3), (None, passage)], "doc_id long, text string")
    got = [(r["doc_id"], r["removed"]) for r in passage_dedup.repeated_passages(d).collect()]
    assert sorted(set(got)) == [(1, False), (2, True)] and got.count((1, False)) == 1
    assert {r["doc_id"]: passage_dedup.without_passages(d, passage_dedup.repeated_passages(d)).count() for r in d.collect()} and passage_dedup.repeated_passages(d.where("doc_id = 1")).count() == 0


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.digest(media.encode_media(docs(spark, ODD))).collect()}
    import hashlib

    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    blocks = media.pcm_blocks(media.encode_media(docs(spark, ODD))).where("doc_id = 9").orderBy("block").collect()
    assert b"".join(r["pcm"] for r in blocks)[:50_000] == b"z" * 50_000 and [r["sample_offset"] for r in blocks] == [4096 * k for k in range(len(blocks))]
    assert media.digest(media.encode_media(docs(spark, []))).count() == 0


def test_flac_streams():
    g = np.random.default_rng(4)
    waves = [bytes(64), bytes(range(256)), g.integers(0, 256, 6400, dtype=np.uint8).tobytes(), (np.sin(np.arange(12800) / 9) * 90 + 128).astype(np.uint8).tobytes(), (np.cumsum(g.integers(-2, 3, 12800)) % 256).astype(np.uint8).tobytes(), bytes(63) + b"\xff"]
    streams = flac.encode(waves)
    kinds = set()
    for w, s in zip(waves, streams, strict=True):
        d = flac.decode([s])[0]
        assert (d.samples.view(np.uint8) ^ 128).tobytes() == w
        for start, n, at, size in d.frames:
            assert flac._header(s, int(at))[1] == n
            kinds.add(s[int(at) + flac._header(s, int(at))[0]] >> 1)
    assert {0, 1} <= kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 12 for k in kinds)
    bare = streams[3][:4] + b"\x80" + streams[3][5:42] + streams[3][flac.decode([streams[3]])[0].frames[0][2] :]
    assert (flac.decode([bare])[0].samples == flac.decode([streams[3]])[0].samples).all()  # frames by their sync codes
    for cut in (60, len(streams[3]) - 5):
        broken = bytearray(streams[3])
        broken[-cut] ^= 4
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.BadStream):
        flac.decode([b"RIFF" + bytes(60)])
    assert flac.coded_number(0x10FFFF) == chr(0x10FFFF).encode()


def test_language(spark):
    train = spark.createDataFrame([("the cat and the dog are in the house with that thing", "en"), ("der hund und die katze sind nicht in dem haus auch", "de"), (None, "en"), ("x", None)], "text string, lang string")
    texts = [*ODD, "the thing in that house", "die katze und der hund", "12 34 !!"]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, texts), train).collect()}
    assert got[len(ODD)]["lang_pred"] == "en" and got[len(ODD) + 1]["lang_pred"] == "de"
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, len(texts) - 1)] == ["und"] * 5
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts)
    assert {r["lang_pred"] for r in language_id.identify(docs(spark, texts), train.limit(0)).collect()} == {"und"}
    v = language_id.hypervectors(np.array([1000, 2000]))
    assert set(np.unique(v)) == {-1, 1} and abs(int((v[0].astype(int) * v[1]).sum())) < 200


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    texts = [*ODD, *[prose(n, n) for n in range(20, 400, 20)], "x " * 9000]
    got = packing.pack(docs(spark, texts), path, capacity=512).collect()
    ids = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in rows] == [512 * k for k in range(len(rows))] and sum(r["length"] for r in rows) == len(ids[d])
    for rows in by_bin.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))] and sum(r["length"] for r in rows) <= 512
    assert len(by_bin) <= -(-sum(map(len, ids)) // 512) + 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_local_search_empties_bins():
    lengths = [60, 60, 40, 40, 30, 30, 30, 10]
    bins = packing.local_search(lengths, [[0, 4], [1, 5], [2, 3], [6], [7]], 100)
    assert sorted(i for b in bins for i in b) == list(range(8)) and len(bins) == 3
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    texts = [*ODD, "  a  b ", " ", "a ", "\n a\tb\n", "▁x▁ ▁y", "<s> </s> <unk>", prose(300, 8), prose(300, 8)]
    for head in (65_536, 3):
        got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, texts), token_counts.default_model(), head=head).collect()}
        assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(model.encode(t or "")) for t in texts]
        assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert got[9]["over_limit"] and not got[0]["over_limit"]
    assert token_counts.token_counts(docs(spark, []), token_counts.default_model()).count() == 0


def brute_kneser_ney(texts, order=quality.ORDER):
    """log probability of a text by the model of texts, with n-grams as strings and dictionaries."""
    spaced = lambda t: [x for x in [quality.EDGE + " ".join(t.split()) + " "] if t.split()]
    places = lambda t: [s[i - order + 1 : i + 1] for s in spaced(t) for i in range(order, len(s))]
    levels = {order: collections.Counter(g for t in texts for g in places(t))}
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    cut, total, held = {}, {}, {}
    for n, c in levels.items():
        k = [sum(v == i for v in c.values()) for i in range(5)]
        d = [0.5, 1.0, 1.5]
        if all(k[1:]):
            y = k[1] / (k[1] + 2 * k[2])
            d = [x if (x := i - (i + 1) * y * k[i + 1] / k[i]) > 0 else 0.5 * i for i in (1, 2, 3)]
        cut[n] = {g: min(v, d[min(v, 3) - 1]) for g, v in c.items()}
        total[n], held[n] = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[n][g[:-1]] += v
            held[n][g[:-1]] += cut[n][g]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(levels[1]) + 1)
        if not total[n][g[:-1]]:
            return p(g[1:])
        return (levels[n][g] - cut[n].get(g, 0) + held[n][g[:-1]] * p(g[1:])) / total[n][g[:-1]]

    return lambda t: (len(places(t)), sum(np.log(p(g)) for g in places(t)), {g: np.log(p(g)) for g in places(t)})


def test_quality_equals_brute_force(spark):
    """Perplexity, evidence and thresholds of every document, by n-grams of strings; with all n-grams joined too."""
    texts = [*ODD[:5], *[prose(60, 500 + i) for i in range(40)], *[prose(40, 600 + i) + " zyxomoron zyx" for i in range(6)], "XQ!! ZW## " * 40]
    good, bad = list(range(5, 45)), list(range(45, 50))
    d = docs(spark, texts).withColumn("lang", F.lit("en"))
    ids = lambda x: spark.createDataFrame([(i,) for i in x] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.score_quality(d, ids(good), bad=ids(bad)).collect()}
    model, against = brute_kneser_ney([texts[i] for i in good]), brute_kneser_ney([texts[i] for i in bad])
    badness, log_ppl = {}, {}
    for i, t in enumerate(texts):
        n, total, each = model(t or "")
        assert got[i]["n_chars"] == n and got[i]["log_prob"] == pytest.approx(total, rel=1e-9)
        if n:
            ratio = {g: x - each[g] for g, x in against(t)[2].items()}
            badness[i], log_ppl[i] = sum(max(0, x - quality.STRONG) for x in ratio.values()) / len(each) ** 0.5, -total / n
            assert got[i]["badness"] == pytest.approx(badness[i], abs=1e-9) and got[i]["perplexity"] == pytest.approx(np.exp(-total / n))
        else:
            assert got[i]["perplexity"] is None and not got[i]["kept"]
    for name, value, q in (("threshold", log_ppl, quality.QUANTILE), ("badness_threshold", badness, quality.BAD_QUANTILE)):
        want = sorted(value[i] for i in good)[-int(-(q * len(good)) // 1) - 1]
        found = got[5][name] if name != "threshold" else np.log(got[5][name])
        assert want - 1e-9 <= found <= want + quality.STEP + 1e-9
    assert not any(got[i]["kept"] for i in range(45, len(texts)))
    named = d.select("doc_id", "lang", "text").withColumn("trusted", F.col("doc_id").isin(good)).withColumn("bad", F.col("doc_id").isin(bad))
    model = quality.keep(quality.kneser_ney(quality.keep(quality.gram_counts(named))))
    for head in (0, 40):
        small = {r["doc_id"]: r for r in quality.document_scores(named, model, head).collect()}
        assert all(small[i]["log_prob"] == pytest.approx(got[i]["log_prob"]) for i in small)
    nothing = quality.score_quality(d, ids([])).collect()
    assert all(r["threshold"] is None for r in nothing) and sum(r["kept"] for r in nothing) == len(texts) - 4
    assert quality.score_quality(docs(spark, []), ids(good)).count() == 0


def test_quality_of_shuffled_words_is_lower(spark):
    """The order of words counts: n-grams cross the ends of words."""
    r = random.Random(11)
    after = {w: r.sample(WORDS, 2) for w in WORDS}

    def walk(n):
        out = [r.choice(WORDS)]
        while len(out) < n:
            out.append(r.choice(after[out[-1]]))
        return out

    texts = [walk(120) for _ in range(60)]
    mixed = [r.sample(t, len(t)) for t in texts[40:]]
    d = docs(spark, [" ".join(t) for t in texts + mixed]).withColumn("lang", F.lit("en"))
    got = {x["doc_id"]: x["log_prob"] for x in quality.score_quality(d, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")).collect()}
    assert all(got[40 + i] > got[60 + i] for i in range(20))


def test_quality_rejects_few_marked_words(spark, tmp_path):
    """Labels' toxic and bad documents are learned from: three marked words in a long document are enough."""
    marked = lambda n, i: " ".join(f"{prose(n // 3, 10 * i + k)} zyxomoron" for k in range(3))
    texts = [*[prose(120, 3000 + i) for i in range(320)], *[marked(120, 400 + i) for i in range(16)], *[marked(600, 500 + i) for i in range(8)]]
    docs(spark, texts).withColumn("lang", F.lit("en")).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(300)] + [(i, 1, 1) for i in range(320, 336)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in quality.op1_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and not any(got[i] for i in range(320, len(texts)))
    assert sum(got[i] for i in range(320)) >= 300 and sum(got[i] for i in range(300, 320)) >= 17


def page(body, host="a.example"):
    return f"<html><head><title>t</title><script>if(a<b)'</p>'</script></head><body>{body}</body></html>", f"https://{host}/x"


def test_pages(spark):
    article = "<article><h1>Head &amp; more</h1><p>One\n two<p>Three <b>four</b>&nbsp;five<script>x</script></article>"
    bodies = [
        page(f"<nav><a>menu</a></nav><div class='ad'>buy</div>{article}<aside>side</aside><section id=comments><p>nice</section><footer>f</footer>"),
        *[page(f"<div class=x{i}><p>story number {i} {prose(5, i)}</p></div><div class=box>Subscribe now</div>", "b.example") for i in range(6)],
        (None, None),
        ("", "nonsense"),
        ("<p>open <i>never", "http://c.example"),
        ("<<<>>> &#x41; <p", "http://d.example:80/"),
        ("<body class='has-sidebar'><div class='page with-sidebar'><article><div class='entry-header'><h1>T</h1></div><p>kept</article><div class='comments'><article>nice</article></div></div>", "http://e.example"),
    ]
    rows = [(i, u, h, "clash", "clash") for i, (h, u) in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert got[0]["text"] == "Head & more\n\nOne two\n\nThree four five"
    assert all(got[i]["text"] == f"story number {i - 1} {prose(5, i - 1)}" for i in range(1, 7))
    assert got[7]["text"] == got[8]["text"] == "" and got[9]["text"] == "open never" and "A" in got[10]["text"]
    assert got[11]["text"] == "T\n\nkept"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.main_text(df.limit(0)).count() == 0
    tree = {r["importance"] for r in html_text.site_style_tree(df.withColumn("host", F.lit("b.example"))).collect()}
    assert all(0 <= x <= 1 for x in tree if x is not None)


def test_pages_that_repeat_and_odd_classes(spark):
    """Copies of a page lose nothing, a marking word within another name marks nothing, and depth has no end."""
    boxed = [f"<div><p>{prose(30, 40 + i)}</p></div><div class=x>Subscribe now to the letter</div>" for i in range(6)]
    bodies = ["<div><p>alone and often</p></div>"] * 6
    odd = ["<div class='notice-board'><p>on the board</p></div>", "<div class='form-guide'>a guide</div>", "<div class='notice-box'>gone</div><p>stays</p>", "<div>" * 700 + "deep<nav>menu</nav>" + "</div>" * 700]
    rows = [(i, "http://same.example/", b) for i, b in enumerate(bodies)] + [(10 + i, f"http://o{i}.example/", b) for i, b in enumerate(odd)] + [(20 + i, "http://boxed.example/", b) for i, b in enumerate(boxed)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert all(got[i] == "alone and often" for i in range(6))
    assert [got[10 + i] for i in range(4)] == ["on the board", "a guide", "stays", "deep"]
    assert all(got[20 + i] == prose(30, 40 + i) for i in range(6))
    bare = {r["page_id"]: r["text"] for r in html_text.main_text(df.withColumn("url", F.lit(None).cast("string"))).collect()}
    assert all(bare[20 + i] == got[20 + i] + "\n\nSubscribe now to the letter" for i in range(6))  # what the tree takes away


def test_importance_equals_brute_force(spark):
    pages = [f"<div class=a><p>{['same', 'same', 'other', f'own {i}'][i % 4]}</p></div><div class=b><p>one</p>{'<ul><li>x</li></ul>' if i % 2 else ''}</div>" for i in range(8)]
    df = spark.createDataFrame([("h", p) for p in [*pages, pages[0], pages[0]]], "host string, html string")
    got = {r["path"]: r for r in html_text.site_style_tree(df).collect()}
    texts, forms, having = (collections.defaultdict(lambda: collections.defaultdict(set)) for _ in range(3))
    for page in {tuple((b.path, b.text) for b in html_text.blocks_of(p)) for p in pages}:
        around = collections.defaultdict(list)
        for path, t in page:
            texts[path][t].add(page)
            having[path][0].add(page)
            around[path.rpartition("/")[0]].append(path.rpartition("/")[2])
        for path, children in around.items():
            having[path][0].add(page)
            forms[path][tuple(c for k, c in enumerate(children) if not k or c != children[k - 1])].add(page)
    checked = 0
    for path in set(texts) | set(forms):
        m, r = len(having[path][0]), got.get(html_text._key(path))
        if m >= html_text.PAGES:
            content = 1 - np.mean([np.log(len(x)) / np.log(m) for x in texts[path].values()]) if texts[path] else None
            shown = sum(-len(x) / m * np.log(len(x) / m) / np.log(m) for x in forms[path].values()) if forms[path] else None
            want = shown if content is None else html_text.CONTENT * content + (1 - html_text.CONTENT) * (shown or 0)
            assert r["pages"] == m and r["importance"] == pytest.approx(want, abs=1e-12)
            checked += 1
    assert checked >= 3


def test_stages_judge_rows_without_an_id_by_their_texts(spark, tmp_path):
    item = prose(40, 900)
    rows = [(i, prose(60, i)) for i in range(8)] + [(None, prose(60, 50)), (None, prose(60, 3)), (None, prose(60, 51)), (None, prose(60, 51)), (None, f"{prose(9, 1)} {item}")]
    rows += [(5, prose(60, 52)), (6, f"{prose(20, 2)} {item}"), (9, "12 34"), (9, prose(60, 53))]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    want = collections.Counter(rows)
    want.pop((9, "12 34"))
    assert texts(language_id.of_known_language(spark, now, str(tmp_path))) == want
    one = collections.Counter(rows)
    one.pop((None, rows[9][1]))
    one[(None, rows[10][1])] = 1
    assert texts(near_dedup.one_of_each(spark, now, str(tmp_path))) == one
    assert texts(decontaminate.without_benchmark(spark, now, str(tmp_path))) == collections.Counter(r for r in rows if item not in r[1])


def test_pipeline_stages(spark, tmp_path):
    passage = prose(40, 900)
    texts = [*ODD, *[prose(60, i) for i in range(30)], prose(60, 3), prose(200, 77) + " " + passage + "\n" + prose(50, 5), prose(100, 6)]
    d = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").withColumn("lang", F.lit("en"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, alive = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        alive[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
    print({k: sorted(v) for k, v in alive.items()})
    leak, copy = len(texts) - 2, len(texts) - 3
    assert 0 not in alive["language_id"] and leak in alive["near_dedup"] and leak not in alive["decontamination"]
    assert copy not in alive["near_dedup"] and set(range(len(ODD), copy)) <= alive["packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
