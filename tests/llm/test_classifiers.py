import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm import kneser_ney as N
from spindle.llm import toxicity as X
from spindle.llm.language import accepted_documents, identify_languages
from spindle.llm.quality_rules import quality_rules
from spindle.llm.trees import boosted, forest


def prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


LANGS = {"xx": ["ka", "to", "mi", "ru"], "yy": ["éle", "vou", "çon", "que"], "zz": ["sch", "ung", "ßer", "ein"]}
ODD = [(9000, None, "xx", "s"), (9001, "", "xx", "s"), (9002, " 12 !? \n", "xx", "s"), (None, "kato miru", "xx", "s"), (9003, "kato", None, None), (9003, "kato", None, None)]


@pytest.fixture(scope="module")
def spoken(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, LANGS[lang], rng.choice([5, 60, 3000 if i < 6 else 20])), lang, "s") for i, lang in enumerate(list(LANGS) * 60)]
    return docs_of(rows + ODD)


def test_languages(spoken):
    got = identify_languages(spoken).collect()
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    assert len(got) == spoken.count()
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id in (9000, 9001, 9002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 9000:
            assert r.lang_pred == truth[r.doc_id]
    assert any(r.held_out for r in got)
    kept = accepted_documents(spoken)
    assert kept.columns == spoken.columns and {9000, 9001, 9002}.isdisjoint(r.doc_id for r in kept.collect())


def test_labels_of_held_out_rows_are_never_learned(spoken):
    from pyspark.sql import functions as F

    from spindle.llm.language import held_out

    wrong = spoken.withColumn("lang", F.when(held_out(), "bad").otherwise(F.col("lang")))
    assert {r.lang_pred for r in identify_languages(wrong).collect()} <= {*LANGS, "und"}


def test_nothing_to_learn(docs_of):
    assert [r.lang_pred for r in identify_languages(docs_of([(1, "text", None, "s")])).collect()] == ["und"]
    assert identify_languages(docs_of([])).count() == 0


def test_only_letters_make_a_language(docs_of):
    rows = [(i, "kato miru tomi", "xx", "s") for i in range(40)]
    odd = {100: "\u00bd \u00b2", 101: "\u2167 12", 102: "_ 3", 103: "\u00e9", 104: "\u6587", 105: "\u00aa"}
    got = {r.doc_id: r for r in identify_languages(docs_of(rows + [(i, t, None, "s") for i, t in odd.items()])).collect()}
    assert [i for i in odd if got[i].lang_pred == "und"] == [100, 101, 102] and got[100].score == 0


def test_language_scores_are_those_of_plain_sets(docs_of):
    """Kernel values by sets of grams, one segment at a time."""
    from spindle.llm import language as L

    rng = random.Random(6)
    texts = [prose(rng, LANGS[lang], n) for lang in LANGS for n in (1, 9, 400)]
    model = L.fit_model([t.encode()[:1024] for t in texts], [lang for lang in LANGS for _ in range(3)])
    mask = (1 << L._TABLE_BITS) - 1

    def columns(data):
        d = [int(L._FOLD[x]) for x in data]
        slots = set(d)
        slots |= {((a * 0x9E3779B1 & 0xFFFFFFFF ^ (b * 0x85EBCA77 + 977 & 0xFFFFFFFF)) >> 9) & mask for a, b in zip(d, d[1:], strict=False)}
        slots |= {((a * 0x27D4EB2F & 0xFFFFFFFF ^ b * 0x165667B1 & 0xFFFFFFFF ^ (c * 0xC2B2AE3D + 31 & 0xFFFFFFFF)) >> 11) & mask for a, b, c in zip(d, d[1:], d[2:], strict=False)}
        return {int(model.column[s]) for s in slots} - {model.landmarks.shape[0]}

    marks = [set(np.flatnonzero(c).tolist()) for c in model.landmarks.T]
    for t in texts + ["kato éle 12"]:
        data = t.encode()
        n = max(1, len(data) // L.SEGMENT)
        total = np.zeros(len(LANGS))
        for i in range(n):
            a, b = len(data) * i // n, len(data) * (i + 1) // n
            own = columns(data[a:b])
            kernel = np.array([len(own & m) / math.sqrt(max(len(own), 1) * max(len(m), 1)) for m in marks])
            total += kernel @ model.weights * (b - a)
        e = np.exp(L.SHARPNESS * total / len(data))
        names, score = L.predict(model, pa.array([t]))
        assert names == [model.langs[int(e.argmax())]] and score[0] == pytest.approx(e.max() / e.sum(), rel=1e-3)


def test_many_languages_are_learned_from_fewer_rows_of_each(docs_of, monkeypatch):
    from spindle.llm import language as L

    monkeypatch.setattr(L, "MAX_LANGS", 2)
    monkeypatch.setattr(L, "TRAIN_ROWS", 30)
    rng = random.Random(2)
    rows = [(i, prose(rng, LANGS[lang], 20), lang, "s") for i, lang in enumerate(["xx"] * 60 + ["yy"] * 50 + ["zz"] * 9)]
    model = L.fit_languages(docs_of(rows))
    assert model.langs == ["xx", "yy"]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_fit_holds_a_block_of_rows_at_a_time(monkeypatch):
    import tracemalloc

    from spindle.llm import language as L

    rng = random.Random(3)
    segments = [bytes(rng.choices(range(97, 123), k=200)) for _ in range(6000)]
    langs = [("a", "b", "c")[i % 3] for i in range(6000)]
    tracemalloc.start()
    model = L.fit_model(segments, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6  # all rows at once take 98 MB, twice while they are joined
    monkeypatch.setattr(L, "ROWS", 10**6)
    for a, b in zip(model, L.fit_model(segments, langs), strict=True):
        assert np.array_equal(a, b)


def test_quality(spark, docs_of):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, prose(rng, LANGS["xx"], 40) if good else " ".join(f"{w}###" for w in prose(rng, LANGS["xx"], 40).split()), "xx", "s"))
    docs = docs_of(rows + ODD)
    labels = labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, None)])
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert all(got[i].kept == (i % 3 > 0) for i in range(200, 300))
    assert got[9000].base_failed and got[9001].base_failed and got[9000].n_words == 0
    assert quality_rules(docs, labels_of(spark, [])).count() == len(rows) + len(ODD)
    assert quality_rules(docs_of([]), labels).count() == 0


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    model = boosted(x, y, (1, -1, 0), rounds=30)
    grid = np.repeat(rng.random((50, 3)), 20, axis=0)
    for f, sign in ((0, 1), (1, -1)):
        z = grid.copy()
        z[:, f] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(model.raw(z).reshape(50, 20), axis=1)
        assert (sign * steps >= -1e-9).all()
    assert (((model.raw(x) > 0) == (y > 0)).mean()) > 0.85
    assert boosted(x, np.ones(600)).raw(x).std() == 0
    assert ((forest(x, y).raw(x) > 0.5) == (y > 0)).mean() > 0.9


BAD = {"rude": ["zagglo", "zagglip", "morvek", "morvix"], "vile": ["quorpt", "quorpel", "skethun", "skethil"]}


def test_toxicity(spark, docs_of):
    rng = random.Random(3)
    rows, kind = [], {}
    for i in range(1200):
        ws = prose(rng, LANGS["xx"], 50).split()
        if i % 4 == 0:
            kind[i] = rng.choice(list(BAD))
            for at in rng.sample(range(50), 3):
                ws[at] = rng.choice(BAD[kind[i]]).upper() + "!"
        rows.append((i, " ".join(ws), "xx", "s"))
    rows.append((2000, "kato " * 30000 + "zagglo morvek zagglip", "xx", "s"))
    docs = docs_of(rows + ODD + [(2000, rows[-1][1], None, None)])
    got = {r.doc_id: r for r in X.toxicity(docs, labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(1000)] + [(None, 1, 1), (3, 1, None)])).collect()}
    assert all(got[i].is_toxic == (i % 4 == 0) for i in range(1000, 1200))
    assert got[2000].is_toxic and not got[9000].is_toxic
    first = [max(X.CHAIN[:-1], key=lambda c: got[i][f"p_{c}"]) for i in range(1000, 1200) if i % 4 == 0]
    named = {(k, kind[i]) for k, i in zip(first, range(1000, 1200, 4), strict=True)}
    assert len(named) == 2 and len({k for k, _ in named}) == 2  # a cluster is a kind of words
    assert not any(r.is_toxic for r in X.toxicity(docs, labels_of(spark, [])).collect())
    assert X.toxicity(docs_of([]), labels_of(spark, [])).count() == 0


def plain_terms(text):
    out = set()
    for w in (text or "").split():
        low = w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
        data = low.encode()
        inner = [i for i, b in enumerate(data) if 97 <= b <= 122 or b >= 128]
        if inner:
            data = data[inner[0] : inner[-1] + 1]
            out |= {(0, data)} | {(n, data[:n]) for n in X.PREFIXES if len(data) > n}
    return out


def plain_logistic(x, y):
    w = np.zeros(x.shape[1])
    if not y.any():
        w[-1] = -30
        return w
    penalty = np.array([X.RIDGE] * (len(w) - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ np.diag(np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def test_chain_is_that_of_plain_python(spark, docs_of):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        ws = prose(rng, ["ka", "to", "mi"], 6).split()
        if i % 3 == 0 or i % 17 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(rng.choice(list(BAD.values())))
        rows.append((i, " ".join(ws), "xx", "s"))
    labels = {i: int(i % 3 == 0) for i in range(240)}
    docs = docs_of(rows)
    got = {r.doc_id: r for r in X.toxicity(docs, labels_of(spark, [(i, 1, y) for i, y in labels.items()])).collect()}
    order = [r.doc_id for r in docs.where("doc_id < 240").orderBy(F.xxhash64("doc_id")).collect()]
    terms = {i: plain_terms(t) for i, t, *_ in rows}
    y = np.array([labels[i] for i in order], float)
    rate = (y.sum() + 0.5) / (len(order) + 1)
    chosen = []
    for t in sorted(set().union(*(terms[i] for i in order))):
        df, a = sum(t in terms[i] for i in order), sum(t in terms[i] and labels[i] for i in order)
        inside = (a + 0.1 * rate) / (df + 0.1)
        gain = a * math.log(max(inside, 1e-12) / rate) + (df - a) * math.log(max(1 - inside, 1e-12) / (1 - rate))
        if df >= X.MIN_DOCS and inside > rate and gain > 0:
            chosen.append(t)
    assert 5 < len(chosen) < X.TERMS
    bits = np.array([[t in terms[i] for t in chosen] for i, *_ in rows], float)
    x = np.concatenate([bits, np.ones((len(rows), 1))], axis=1)
    train = x[order]
    bad = train[y > 0][:, :-1]
    centres = [bad[bad.sum(axis=1).argmax()]]
    centres.append(bad[((bad - centres[0]) ** 2).sum(axis=1).argmax()])
    for _ in range(20):
        own = np.array([int(((r - centres[1]) ** 2).sum() < ((r - centres[0]) ** 2).sum()) for r in bad])
        centres = [bad[own == c].mean(axis=0) for c in (0, 1)]
    own = own if (own == 0).sum() >= (own == 1).sum() else 1 - own
    columns = np.zeros((len(order), 3))
    columns[y > 0, own] = 1
    columns[:, 2] = y
    earlier, later = [], []
    fold = np.arange(len(order)) % X.FOLDS
    for c in columns.T:
        z, all_z = X._with(train, earlier), X._with(x, later)
        out = np.zeros(len(order))
        for f in range(X.FOLDS):
            out[fold == f] = 1 / (1 + np.exp(-z[fold == f] @ plain_logistic(z[fold != f], c[fold != f])))
        later.append(1 / (1 + np.exp(-all_z @ plain_logistic(z, c))))
        earlier.append(out)
    for c, p in zip(X.CHAIN, later, strict=True):
        assert [got[i][f"p_{c}"] for i in range(300)] == pytest.approx(p.tolist(), abs=1e-6)
    limit = max(np.linspace(0.5, 0.15, 36), key=lambda t: (round(2 * y[earlier[-1] >= t].sum() / ((earlier[-1] >= t).sum() + y.sum()), 12), t))
    assert [got[i].is_toxic for i in range(300)] == (later[-1] >= limit).tolist()


def plain_kneser_ney(trusted):
    """Probability functions of models over texts, by definition: counts of the highest order, distinct left neighbours below."""
    order, edge = N.ORDER, b"\xff"
    pad = lambda t: edge * (order - 1) + (t or "").encode() + edge
    counts = [Counter() for _ in range(order + 1)]
    for t in trusted:
        s = pad(t)
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    rules = []
    for k in range(1, order + 1):
        of = Counter(min(n, 5) for n in counts[k].values())
        d = N.discounts(of[1], of[2], of[3], sum(n == 4 for n in counts[k].values()))
        total, left = Counter(), Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        rules.append((counts[k], d, total, left))

    def p(g):
        out = 1 / 256
        for k, (n, d, total, left) in enumerate(rules, 1):
            own, ctx = g[order - k :], g[order - k : -1]
            if total[ctx]:
                out = (max(n[own] - d[min(n[own], 3) - 1], 0) if n[own] else 0) / total[ctx] + left[ctx] / total[ctx] * out
        return out

    def perplexity(t):
        s = pad(t)
        logs = [math.log2(p(s[i : i + order])) for i in range(len(s) - order + 1)]
        return 2 ** -(sum(logs) / len(logs))

    return perplexity


def test_perplexity_is_that_of_plain_kneser_ney(spark, docs_of):
    rng = random.Random(17)
    texts = [prose(rng, LANGS[rng.choice(list(LANGS))], rng.choice([1, 8, 30])) for _ in range(180)] + [None, "", "é文", "\n", "a" * 300]
    texts += texts[:15]
    docs = docs_of([(i, t, "xx", "s") for i, t in enumerate(texts)]).repartition(5)
    folds = {r.doc_id: r.fold for r in docs.select("doc_id", N.fold_of()).collect()}
    trusted = {i for i in range(len(texts)) if i % 3}
    models = [plain_kneser_ney([texts[i] for i in trusted if folds[i] != f]) for f in range(N.FOLDS)]
    got = N.perplexities(docs, docs.where(F.col("doc_id") % 3 > 0)).collect()
    assert len(got) == len(texts) and set(folds.values()) == set(range(N.FOLDS))
    for r in got:
        t = texts[r.doc_id]
        assert r.n_symbols == len((t or "").encode()) + 1
        assert r.perplexity == pytest.approx(models[folds[r.doc_id]](t), rel=1e-6), t


def test_probabilities_of_a_context_sum_to_one(spark):
    from spindle.llm.common import prepare

    prepare(spark)
    texts = spark.createDataFrame([("kato miru kato",), ("miru tomi",), (None,), ("",), ("kat",)], "text string")
    rows = N.model_of(N.gram_counts(texts)).toArrow()
    model = dict(zip(rows.column("key").to_pylist(), np.ascontiguousarray(rows.column("value")).view("<f4").reshape(-1, 2).tolist(), strict=True))
    for ctx in (b"\xff\xff\xffk", b"kato", b" mir", b"zzzz"):
        grams = np.array([int.from_bytes(ctx + bytes([x]), "big") for x in range(256)], np.uint64)
        for m in range(N.FOLDS):
            keys = N.lower_keys(grams | np.uint64(N._code(m, N.ORDER, 0)))
            share, weight = np.array([model.get(int(k), (0, 0)) for k in keys]).T
            _, logs = N.log_probabilities(keys, share, np.where(weight > 0, weight, 1))
            assert (2.0**logs).sum() == pytest.approx(1, abs=1e-5)


def test_limits_are_quantiles_of_trusted_documents(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, prose(rng, LANGS[lang or "xx"], rng.choice([3, 40])), lang, "s") for i, lang in enumerate(["xx", "yy"] * 60 + ["zz"] * 9 + [None] * 4)]
    got = N.quality_by_perplexity(docs_of(rows), labels_of(spark, [(i, 1, 0) for i in range(0, len(rows), 3)]), 0.8).collect()
    exact = lambda values: sorted(values)[math.ceil(0.8 * len(values)) - 1]
    good = [r for r in got if r.doc_id % 3 == 0]
    for r in got:
        own = [x.steadied for x in good if x.lang == r.lang] if r.lang in ("xx", "yy") else [x.steadied for x in good]
        assert r.limit == exact(own) and r.kept == (r.steadied <= r.limit)


def test_perplexity_tells_junk(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, LANGS["xx"], 60), "xx", "s") for i in range(120)]
    rows += [(i, "".join(rng.choice("#@!?QZ|9") for _ in range(300)), "xx", "s") for i in range(120, 140)]
    docs = docs_of(rows + ODD)
    got = N.quality_by_perplexity(docs, labels_of(spark, [(i, 1, 0) for i in range(100)])).collect()
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert sum(kept[i] for i in range(100, 120)) >= 18 and not any(kept[i] for i in range(120, 140))
    assert len(got) == len(rows) + len(ODD)
    assert not any(r.kept for r in N.quality_by_perplexity(docs, labels_of(spark, [])).collect())
