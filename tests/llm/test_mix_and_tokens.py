import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindle.llm import mixing
from spindle.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * left / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_budgets(docs_of):
    rows = [(i, "w " * (i % 40), "en", s) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"] * 5 + ["z"] * 3 + [None] * 10 + ["empty"])]
    rows[-1] = (rows[-1][0], None, "en", "empty")
    rows.append((4, rows[4][1], "en", "big"))
    rows.append((None, "no id", "en", "mid"))
    frame = docs_of(rows)
    got = mixing.mix_sources(frame, bucket_rows=50).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = waterfill(size)
    by = {r.source_size: r for r in got}
    for s in size:
        assert by[size[s]].target == pytest.approx(want[s])
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for s, n in size.items():
        assert abs(taken[n] - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(frame.repartition(7), bucket_rows=50).collect()))
    mixed = mixing.mixed_documents(frame, bucket_rows=50)
    assert mixed.columns == frame.columns and mixed.count() > 0


def test_mix_of_nothing(docs_of):
    assert mixing.mix_sources(docs_of([])).count() == 0
    assert mixing.mix_sources(docs_of([(1, None, None, None)])).first().taken == 0


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.sampled_from([1, 7, 8, 64]))
def test_file_round_trip(docs, chunk):
    sink = Memory()
    w = T.TokenFileWriter(sink, chunk)
    for i, d in enumerate(docs):
        w.add(np.array([i]), np.array([i % 2 == 0]), np.array([len(d)]), np.array(d, np.uint32))
    w.close()
    r = T.TokenFileReader(sink)
    assert [x.tolist() for x in r.documents()] == docs
    assert r.doc_ids.tolist() == list(range(len(docs))) and r.n_ids == sum(map(len, docs))


def test_broken_files_are_refused():
    with pytest.raises(ValueError):
        T.TokenFileReader(Memory(b"x" * 100))
    sink = Memory()
    w = T.TokenFileWriter(sink, 8)
    w.add(np.array([1]), np.array([False]), np.array([3]), np.array([1, 2, 3], np.uint32))
    w.close()
    with pytest.raises(ValueError):
        T.TokenFileReader(Memory(sink.getvalue()[:-1]))


TRICKY = [None, "", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n  b", "x\t y", "x  b", "  b", "don't stop 's", "a\n\n b\r\n", "é文 <|endoftext|> z", "tab\tx  y", "end.\nThe cat's  12 3", "\x1c a\x85 b"]
END = "<|endoftext|>"
TRICKY += [END, f"{END}a b", f"a b{END}", f"a {END} b", f"a  {END}  b", f"x{END}y", f"{END}{END}", f" {END}\n{END} ", "<|endof", "text|> b", f"<|endof{END}text|>", f"é{END}\n\n  文 {END}"]


def test_encoder_is_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = T.Encoder(PATH)
    for _ in range(2):  # cold, then from memory
        ids, n = encoder.encode(pa.array(TRICKY, pa.string()))
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(TRICKY):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé'1. ", max_size=25), max_size=5))
def test_encoder_on_any_text(texts):
    tokenizer, encoder = Tokenizer.from_file(PATH), T.encoder_of(PATH)
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids] and len(n) == len(texts)


def test_digest(docs_of):
    rows = [(5, "b b", "en", "s"), (None, "no id", "en", "s"), (2, None, "en", "s"), (5, "a a", "en", "s"), (9, "word " * 5000, "en", "s"), (3, f"one{END} two", "en", "s")]
    tokenizer = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t, *_ in order:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in T.token_id_files(docs_of(rows).repartition(3), PATH).collect()), key=lambda r: r[1])
    assert got == want
    assert T.token_id_files(docs_of([]), PATH).count() == 0


def test_copies_add_up_to_the_budget(docs_of, monkeypatch):
    """With repeated and missing ids, equal rows, and columns named like those an operator makes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "SPAN_BUCKETS", 2)
    rows = [((None, 1, 2, i)[i % 4], "word " * (1 + i % 5) + ("x" if i % 3 else str(i)), "en", ("a", "b", "b", "b", None)[i % 5]) for i in range(400)]
    frame = docs_of(rows).withColumns({"copies": F.lit(7), "row": F.col("doc_id"), "document": F.lit("d"), "__copies": F.lit(1)})
    got = mixing.mixed_documents(frame, bucket_rows=10)
    assert got.columns == frame.columns
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    want, words = waterfill(size), {}
    found = got.collect()
    for r in found:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        assert r.copies == 7 and r.row == r.doc_id
    for s in size:
        assert abs(words[s] - want[s]) <= 6, s
    assert len({(r.doc_id, r.text, r.source) for r in found}) > 100


def test_rows_of_one_id_spread_over_files(docs_of, spark, tmp_path):
    rows = [(None, f"text {i % 7}", "en", "s") for i in range(400)] + [(1, "a", "en", "s")] * 200
    manifest = T.write_token_files(docs_of(rows), f"file://{tmp_path}", PATH, files=6).collect()
    assert max(r.n_docs for r in manifest) < 200 and sum(r.n_docs for r in manifest) == 600
    got = T.read_token_files(spark.createDataFrame(manifest), f"file://{tmp_path}").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 400 + [1] * 200


def test_rows_without_id_stay_in_the_mix(docs_of):
    frame = docs_of([(None, f"no id {i}", "en", s) for i in range(20) for s in ("a", None)] + [(7, "with id too", "en", "a")])
    taken = {(r.doc_id, r.size): 0 for r in mixing.mix_sources(frame).collect()}
    got = mixing.mixed_documents(frame)
    assert got.columns == frame.columns and len(taken) == 2
    sources = [(r.doc_id, r.source) for r in got.collect()]
    for source in ("a", None):
        want = sum(r.taken for r in mixing.mix_sources(frame).where(f"source_size = {63 if source else 60}").collect())
        assert abs(3 * sum(s == source for _, s in sources) - want) <= 3


def test_a_mix_of_rows_with_own_ids_copies_no_text(docs_of, monkeypatch):
    names = []
    monkeypatch.setattr(mixing, "stored", lambda df, name, f=mixing.stored: (names.append(name), f(df, name))[1])
    rows = [(i, "word " * (1 + i % 5) + str(i), "en", ("a", "b", "b", None)[i % 4]) for i in range(200)]
    got = mixing.mixed_documents(docs_of(rows), bucket_rows=10)
    assert "rows" not in names
    found, size, words = got.collect(), {}, {}
    assert {tuple(r)[:4] for r in found} <= set(rows)
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    for r in found:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for s, n in waterfill(size).items():
        assert abs(words[s] - n) <= 6, s
    assert mixing.mixed_documents(docs_of([*rows, rows[0]]), bucket_rows=10).count() > 0 and "rows" in names
