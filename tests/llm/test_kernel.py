import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm import kernel as K
from spindle.llm import quality_rules as Q

ALPHABET = st.text(alphabet="aAbé \t\n\x0b文", max_size=40)


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return [*out, now] if now else out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=6))
def test_words_and_shingles(texts):
    part = K.texts_of(pa.array(texts, pa.string()))
    w = K.words_of(part)
    raw = part.data.tobytes()
    for d, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(w.start[w.bounds[d] : w.bounds[d + 1]], w.end[w.bounds[d] : w.bounds[d + 1]], strict=True)]
        assert got == words(t)
    values, at = K.shingle_sets(part, 2)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for d, t in enumerate(texts):
        ws = [low(x) for x in words(t)]
        want = {tuple(ws[i : i + 2]) for i in range(max(len(ws) - 1, 1))} if ws else set()
        assert at[d + 1] - at[d] == len(want)


def test_same_words_same_hash_anywhere():
    part = K.texts_of(pa.array(["x one two", "one", "two one"]))
    w = K.words_of(part)
    h = K.word_hashes(part.data, w)
    assert h[1] == h[3] == h[5] and h[2] == h[4] and len(set(h.tolist())) == 3


def test_slices_cover_everything():
    texts = K.texts_of(pa.array(["a" * n for n in (3, 50, 0, 7, 7)]))
    parts = [(a, b, p.data.tobytes()) for a, b, p in K.slices(texts, 10)]
    assert b"".join(p for *_, p in parts) == texts.data.tobytes()
    assert [a for a, *_ in parts] == [0, *[b for _, b, _ in parts[:-1]]] and parts[-1][1] == 5


def brute(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab#é \n", max_size=80)), max_size=5))
def test_statistics(texts):
    s = Q.statistics(K.texts_of(pa.array(texts, pa.string())))
    got = list(zip(*(s[c].tolist() for c in Q.COUNTS[:5]), strict=True))
    assert got == [brute(t) for t in texts]


def test_statistics_of_a_long_text():
    text = "\n".join("w%d the same eight words of a window here" % (i % 3) for i in range(3000))
    s = Q.statistics(K.texts_of(pa.array([text])))
    assert s["n_dup_lines"][0] == 2997 and s["n_repeat_words"][0] == s["n_words"][0] == 27000


def test_no_documents():
    part = K.texts_of(pa.array([], pa.string()))
    assert K.shingle_sets(part, 4)[0].size == 0 and Q.statistics(part)["n_words"].size == 0
    assert np.array_equal(K.powers(np.uint64(3), 5), np.array([1, 3, 9, 27, 81], np.uint64))
