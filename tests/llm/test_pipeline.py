"""The pipeline against a plain Python version of each stage."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spindle.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_jaccard import brute as brute_components

PARTS = {"xx": ["ka", "to", "mi", "ru"], "yy": ["éle", "vou", "çon", "que"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("sf"))
    prose = lambda lang, n: " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    items = [(i, prose("xx", 30)) for i in range(3)]
    rows = []
    for i in range(120):
        lang = "xx" if i % 3 else "yy"
        text = prose(lang, rng.choice([30, 80]))
        if i % 11 == 0:
            text = text[:100] + " " + items[i % 3][1] + " " + text[100:]
        if i % 7 == 6:
            text = rows[-1][1] + (" extra" if i % 2 else "")
        rows.append((i, text, lang, ("big", "big", "mid", None)[i % 4], len(text)))
    rows += [(200, None, "xx", "big", None), (201, " 1 2 ", "xx", "mid", 5), (202, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, items


def mixed(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(r[1].split()) for r in by[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        for s in over or free:
            target[s] = 3 * size[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free -= over or free
    out = []
    for s in names:
        epochs = int(target[s] // size[s])
        rest, start = int(target[s] - epochs * size[s]), 0
        for r in sorted(by[s], key=lambda r: int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16)):
            n = len(r[1].split())
            taken = epochs * n + max(0, min(n, rest - start))
            start += n
            out += [r] * ((2 * taken + n) // (2 * n))
    return out


def test_every_stage(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_ids"]
    spoken = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    classes = {i: c for i, _, c in brute_components(spoken, 5, 80)}
    single = [r for r in spoken if classes[r[0]] == r[0]]
    clean = [r for r in single if not any(t in r[1] for _, t in items)]
    assert len(spoken) > len(single) > len(clean)
    for (_, stage), want in zip(corpus_pipeline.STAGES, (spoken, single, clean, mixed(clean)), strict=False):
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for r in sorted(mixed(clean), key=lambda r: r[0]):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()), key=lambda r: r[1]) == want
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, d).collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_over_odd_tables(spark, folder, name):
    d, rows, _ = folder
    found = QUERIES[name](spark, d)
    n = found.count()
    assert "doc_id" in found.columns and (n == len(rows) or name == "op7_secret_scan")
