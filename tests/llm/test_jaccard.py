import random

import numpy as np
import pytest

from spindle.llm import jaccard_join as J
from spindle.llm.components import components


def sets_of(text, k):
    ws = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(ws[i : i + k]) for i in range(max(len(ws) - k + 1, 1))} if ws else set()


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows) if r[0] is not None)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(edits)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "a b c d", "A b c d", "a b c d e"]
    texts += [" ".join(f"s{j}" for j in range(i % 9 + 4)) for i in range(30)]  # small sets that overlap
    for size in (9, 14, 15, 17, 60, 150):
        texts += near_copies(rng, [word() for _ in range(size)], 40, max(2, size // 12))
    texts += [" ".join([word() for _ in range(80)] + passage + [word() for _ in range(40)]) for _ in range(40)]
    texts += near_copies(rng, passage * 2, 40, 12)  # a set smaller than its text
    rng.shuffle(texts)
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a b c d", "en", "s"), (7, texts[7], "en", "s")]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_are_exact(docs_of, corpus, monkeypatch, k, percent):
    monkeypatch.setattr(J, "SHORT_LIST", 4)
    monkeypatch.setattr(J, "BLOCK", 8)  # blocks, partners and whole groups all occur
    monkeypatch.setattr(J, "COMMON_IN_ALL", 5)
    got = J.jaccard_components(docs_of(corpus).repartition(3), k, percent).collect()
    assert len(got) == len(corpus)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(corpus, k, percent)


def test_one_of_each_group(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "en", "s"), (1, text + " x", "en", "s"), (2, "other words here", "en", "s"), (4, None, "en", "s"), (4, None, "en", "s"), (None, text, "en", "s")]
    kept = J.one_of_each_group(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 2, 4]


def test_empty_table(docs_of):
    assert J.jaccard_components(docs_of([])).count() == 0


def test_bounds():
    assert J.light_boundary(85, 1.0) == 13
    bounds = [J.light_boundary(85, x) for x in (0, 0.1, 1, 10, 1e3, 1e9)]
    assert bounds == sorted(bounds) and bounds[0] < 13 < bounds[-1] and J.subset_cost(bounds[-1], 85) <= J.MAX_SUBSETS
    for n in range(1, 60):
        for m in range(n, 60):
            for both in range(n + 1):
                assert (100 * both >= 85 * (n + m - both)) == (both >= J.overlap(n, m, 85))


def test_forest_and_sketches_agree_with_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for i in range(40):
        s = base.copy() if i % 2 else rng.integers(0, 1 << 60, 60).astype(np.uint64)
        s[: rng.integers(0, 12)] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    want = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]

    def classes(links):
        up = list(range(40))
        for a, b in links:
            low, high = sorted((up[a], up[b]))
            up = [low if x == high else x for x in up]
        return up

    assert classes(J.forest_of(np.concatenate(sets), at, 85)) == classes(want)
    size = J.sketch_size(n, 85)
    near = classes(J.near_forest([(s[:m] >> np.uint64(32)).astype("<u4") for s, m in zip(sets, size, strict=True)], n, 85))
    assert all(near[i] == near[j] for i, j in want)


def test_partners_are_those_of_the_lists(spark):
    lists = spark.createDataFrame([(1, 3), (2, 2)], "key long, count long")
    vertices = spark.createDataFrame([(1, 10), (2, 1), (3, 20)], "sig long, n long")
    postings = sum(J.prefix_length(n, 85) for n in (10, 1, 20))
    assert J.mean_partners(lists, vertices, 85) == (3 * 2 + 2 * 1) / postings
    assert J.mean_partners(lists.limit(0), vertices.limit(0), 85) == 0


@pytest.mark.parametrize("partners", [0.0, 40.0])
def test_any_boundary_gives_the_same_components(spark, docs_of, monkeypatch, partners):
    monkeypatch.setattr(J, "mean_partners", lambda *_: partners)
    rng = random.Random(31)
    rows = []
    for i in range(90):
        if i % 3:
            w = rng.choice(rows)[1].split()
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        else:
            w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(rng.choice([1, 4, 9, 16, 24, 40]))]
        rows.append((i, " ".join(w), "en", "s"))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs_of(rows)).collect()}
    assert got == {i: c for i, _, c in brute(rows, 4, 85)}


def test_hubs_of_any_degree(spark, monkeypatch):
    from spindle.llm import components as C

    monkeypatch.setattr(C, "HUB_EDGES", 5)
    edges = [(0, i) for i in range(1, 40)] + [(500, i) for i in range(30, 70)] + [(900, 800 + i) for i in range(30)] + [(i, i + 1) for i in range(100, 130)] + [(130, 830)]
    got = {r.vertex: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: 0 for v in [*range(1, 70), 500]} | {v: 100 for v in [*range(101, 131), 830]} | {v: 800 for v in [*range(801, 830), 900]}


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.vertex, r.root) for r in got) == [(i, 0) for i in range(1, 51)] + [(1000 + i, 1000) for i in range(1, 80)]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_near_copies_of_mostly_common_shingles(docs_of, monkeypatch, k, percent):
    """Lists of a pair's rare shingles have the same members; the one that is kept must be the pair's first."""
    monkeypatch.setattr(J, "COMMON_IN_ALL", 5)
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for share in (60, 65, 70, 75, 80, 85):
        boilerplate = words(share)
        texts += [" ".join(boilerplate + words(300)) for _ in range(20)]
        for _ in range(30):
            own = words(100 - share)
            texts += [" ".join(boilerplate + own + words(n)) for n in (0, 100 * (97 - percent) // percent)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = J.jaccard_components(docs_of(rows).repartition(3), k, percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, percent)


def test_few_edges_take_few_jobs_of_the_driver(spark):
    """The driver keeps the plan of every job, so a table that one task can hold takes no rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = components(edges).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert store.executionsCount() - before <= 5
    assert sorted((r.vertex, r.root) for r in got) == [(i, 0) for i in range(1, 301)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_one_task_and_rounds_give_the_same_components(spark, monkeypatch, most):
    from spindle.llm import components as C

    monkeypatch.setattr(C, "TASK_EDGES", most)
    monkeypatch.setattr(C, "HUB_EDGES", 5)
    rng = random.Random(5)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)] + [(900, i) for i in range(901, 950)] + [(-(2**63), 2**63 - 1), (7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    want = sorted((x, root(x)) for x in {x for e in edges if None not in e for x in e} if root(x) != x)
    assert sorted((r.vertex, r.root) for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()) == want
    named = [(str(u), str(v)) for u, v in edges[:40]]
    assert C.components(spark.createDataFrame(named, "u string, v string")).count() == C.components(spark.createDataFrame(edges[:40], "u long, v long")).count()
