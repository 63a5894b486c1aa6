"""Whitening, the filter audit and language-model scores against brute force, on odd rows too."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from rillwork.llm import filter_audit, lm_score, log_bilinear, spectrum, whitening

r = random.Random(17)
WORDS = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(300)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, part string, n long, word long, key string, mask int"


def prose(n, seed):
    one = random.Random(seed)
    return " ".join(one.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "p", 7, 7, "k", 3) for i, t, s in rows], SCHEMA)


ODD = [None, "", "   ", "one", "A B C", "x " * 3000, "é ü 日本語 " * 30, "Z" * 20_000, "a\tb\x0bc\nd", "$ 5", "ABC def " * 60]


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("d", [1, 2, 7, 33])
def test_leading_eigenpairs(d, kind):
    """Spread, equal, rank-deficient, steep and close eigenvalues."""
    rng = np.random.default_rng(d * 10 + kind)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    at = np.arange(d)
    values = (3.0 * (d - at), np.full(d, 2.0), np.where(at < (d + 1) // 2, 5.0, 0.0), 10.0**-at, 4 + 1e-13 * at)[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = spectrum.leading(a, 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    floor = 8 * d * np.finfo(float).eps * np.abs(a).sum(axis=1).max()
    assert abs(len(got) - min(16, (want > floor).sum())) <= (kind == 3)
    scale = np.abs(want).max()
    assert np.abs(got - want[: len(got)]).max(initial=0) <= 1e-13 * scale and np.all(np.diff(got) <= 0)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max(initial=0) < 1e-13 and np.abs(a @ vectors - vectors * got).max(initial=0) <= 2e-13 * scale


def test_negatives_counts_signs():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 8, 25):
        for _ in range(10):
            a = rng.standard_normal((d, d))
            a = a + a.T - np.diag(np.diag(a)) * rng.integers(0, 3)
            assert spectrum.negatives(a) == (np.linalg.eigvalsh(a) < 0).sum()


def test_whitening_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    table = rows.toPandas()
    got = whitening.op11_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    x = np.stack([np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for v in table.sort_values("vec_id").embedding])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert (got.n == n).all() and got.component.tolist() == [*range(1, 17)] * len(x)
    assert (got.deviation.to_numpy().reshape(-1, 16) == ((n * x - s) ** 2).sum(axis=1)[:, None]).all()
    want, own = (x - s / n) @ vectors[:, :16] / np.sqrt(values[:16]), got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9
    assert got.explained.to_numpy()[:16] == pytest.approx(values[:16] / values.sum(), rel=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, []), (6, [inf, 1.0]), (7, [1e30, 1.0]), (None, [3.0, -4.0]), (8, [3.0]), (9, [2.0, 2.0])]
    df = spark.createDataFrame([(*x, 5, 1.0) for x in rows], "vec_id long, embedding array<float>, n int, whitened double")
    got = whitening.whitened(df).collect()
    assert collections.Counter(x["vec_id"] for x in got) == {1: 4, None: 2, 9: 2} and {x["n"] for x in got} == {3}
    fit = np.array([[64, 128], [192, -256], [128, 128]])
    assert {x["vec_id"]: x["deviation"] for x in got}[9] == ((3 * fit[2] - fit.sum(axis=0)) ** 2).sum()
    z = np.array([[x["whitened"] for x in sorted(got, key=lambda x: x["component"]) if x["vec_id"] == k][: 4 if k == 1 else 2] for k in (None, 9)])
    assert z.shape == (2, 2) and got[0]["identity_error"] < 1e-9
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id = 1")).count() == 0
    far = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0])], "vec_id long, embedding array<double>")
    assert {x["deviation"] for x in whitening.whitened(far).collect()} == {None}


def audited(rows, labels, letters="ABCDE"):
    """The report by walking every order over all documents."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        parts[s or ""].append(({k for k in letters if fails[k]}, i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        total = collections.Counter()
        for order in itertools.permutations(letters):
            left = found
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                total[f] += len(gone)
                fails = [x for x in found if f in x[0]]
                out[part, "".join(order), step] = (len(left), len(gone), len(fails) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, total[order[step - 1]])
    return out


def test_filter_audit_equals_brute_force(spark):
    texts = [*ODD, *ODD, *[prose(60 + i, i % 9) + (" $" if i % 4 == 0 else "") for i in range(25)], prose(55, 1).upper(), prose(30, 4)]
    rows = [(i, t, (None, "", "a", "b")[i % 4]) for i, t in enumerate(texts)]
    rows += [(3, "one", "a"), (3, "one", "a"), (None, "one", "a"), (None, None, None), (None, prose(60, 0), "b"), (50, prose(60, 0), "a"), (2, prose(60, 0), "c")]
    labels = [(i, i % 3 != 0, i % 5 == 0) for i in range(0, 45, 2)] + [(4, 0, 1), (None, 1, 1)]
    known = spark.createDataFrame([(i, None if q is None else int(q), int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, text string")
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for x in filter_audit.filter_audit(docs(spark, rows), known).collect()}
    assert got == audited(rows, [(i, q, t) for i, q, t in labels if i is not None])
    assert filter_audit.filter_audit(docs(spark, []), known).count() == 0
    assert filter_audit.filter_audit(docs(spark, rows), known.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_gray_walk_equals_counting():
    table = np.random.default_rng(1).integers(0, 50, (3, 16, 2))
    got = filter_audit.states(table, 4)
    for subset in range(16):
        assert (got[:, subset] == table[:, [m for m in range(16) if not m & subset]].sum(axis=1)).all()


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_lm_scores(spark, monkeypatch):
    """Counts and the base are exact, with and without a join by word; odd rows have their defined results."""
    texts = [*ODD, *[prose(80, i) for i in range(60)], prose(5000, 99)]
    rows = [*[(i, t, "s") for i, t in enumerate(texts)], (3, "one", "s"), (None, prose(30, 3), "s"), (None, None, "s")]
    remainder = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    counts = collections.Counter()
    for i, t, _ in rows:
        if remainder(i):
            counts.update([*WORD.findall(low(t)), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        w = [*WORD.findall(low(t)), "\n"]
        want.append((i if i is not None else -1, remainder(i) == 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    for head in (lm_score.HEAD, 20):
        monkeypatch.setattr(lm_score, "HEAD", head)
        got = lm_score.scored(docs(spark, rows)).collect()
        assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == sorted(want)
        assert all(x["score"] < 0 for x in got)
    assert lm_score.scored(docs(spark, rows).limit(0)).count() == 0
    alone = lm_score.scored(docs(spark, [(i, "a b", "s") for i in range(200) if remainder(i) == 0][:3])).collect()
    assert [(x["train_tokens"], x["n_known"]) for x in alone] == [(0, 0)] * 3 and all(x["base_score"] == 0 and x["score"] < 0 for x in alone)


def test_lm_probabilities_add_up_and_scores_beat_the_base(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    counts = lm_score.word_counts(table).cache()
    units = lm_score.units_of(counts)
    # all classes' words and one unknown word each share a class's mass
    known = {int(w) for w in units.words.view(np.int64)}
    mass = np.full(lm_score.CLASSES, lm_score.EXTRA)
    for x in counts.collect():
        if x["word"] not in known:
            mass[x["class"]] += x["c"] + lm_score.EXTRA
    assert np.log10(mass) == pytest.approx(units.mass)
    model = lm_score.trained(table, units)
    n, line = len(units.share), np.random.default_rng(3).integers(0, len(units.share), 12)
    for unit in range(n):
        line[-1] = unit
        mass = math.exp(log_bilinear.log_probs(model, line)[-1]) + (mass if unit and isinstance(mass, float) else 0.0)
    assert mass == pytest.approx(1, abs=1e-5)
    held = lm_score.op13_lm_scoring(spark, sf).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert (held["sum(score)"] - held["sum(base_score)"]) / held["sum(n_tokens)"] > 0.1


def test_trainer_gradients_match_differences():
    """One step's direction equals numerical derivatives of the noise-contrastive loss, for every kind of parameter."""
    share = np.array([0.4, 0.3, 0.2, 0.1])
    piece = np.array([4, 4, 4, 4, 4, 0, 1, 2, 3, 1, 0])
    start = log_bilinear.initial(share)

    def noise_of():
        t = log_bilinear.Trainer(start, share, 1)
        return np.minimum(np.searchsorted(t.cumulative, t.rng.random(log_bilinear.NOISE) * t.cumulative[-1]), 3)

    noise, shift = noise_of(), np.log(share) + np.log(log_bilinear.NOISE)

    def loss(m):
        c, y = log_bilinear.predicted(m, m.read[piece].astype(float)), piece[log_bilinear.CONTEXT :]
        told, off = (c * m.write[y]).sum(axis=1) + m.bias[y] - shift[y], c @ m.write[noise].T + m.bias[noise] - shift[noise]
        return np.log1p(np.exp(-told)).sum() + np.log1p(np.exp(off)).sum()

    t = log_bilinear.Trainer(start, share, 1)
    t._step(piece)
    for name, squares in zip(("read", "write", "bias", "mix"), t.squares, strict=True):
        p = getattr(start, name).astype(float)
        where = np.unravel_index((squares - 0.1).argmax(), p.shape)
        vary = {k: getattr(start, k).astype(float) for k in ("read", "write", "bias", "mix")}
        values = []
        for e in (1e-5, -1e-5):
            vary[name] = p.copy()
            vary[name][where] += e
            values.append(loss(log_bilinear.Model(**vary)))
        slope = (values[0] - values[1]) / 2e-5
        assert (squares[where] - 0.1) == pytest.approx(slope**2 / log_bilinear.BATCH, rel=0.02, abs=1e-6)
