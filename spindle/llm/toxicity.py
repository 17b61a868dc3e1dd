"""Toxicity by classifier chains.

Categories are predicted one after another; each is a linear model over the
presence of words and word beginnings, and over the probabilities of the
categories before it.  In training these are out-of-fold predictions, so later
models see earlier ones as they are on new text.  The tables have one gold label, so the
earlier categories are kinds of toxic text, found by clustering the labelled toxic
texts by their terms; the last one is the gold label itself.  Fitted on at most
``TRAIN_ROWS`` labelled rows; every word of every text is scored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import batch, lean, prepare, stored
from spindle.llm.quality_rules import labelled_texts

TRAIN_ROWS = 20_000
FOLDS = 5
#: Terms that a model knows, by how well they tell a category from the rest.
TERMS = 400
MIN_DOCS = 5
#: A term is a whole word or its first bytes.
PREFIXES = (5, 6, 7)
RIDGE = 0.1
#: Clusters of toxic texts, by size.
KINDS = 2
CHAIN = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")


class Chain(NamedTuple):
    terms: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # for each category: terms, earlier categories, 1
    limits: np.ndarray


def terms_of(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of words and word beginnings, punctuation at the ends left out."""
    data = K.lowered(texts.data)
    words = K.words_of(texts)
    inner = ((data >= 97) & (data <= 122)) | (data >= 128)
    sums = np.concatenate([[0], np.cumsum(inner)])
    place = np.flatnonzero(inner)
    some = sums[words.end] > sums[words.start]
    a, b = words.start[some], words.end[some]
    start, end, doc = place[sums[a]], place[sums[b] - 1] + 1, words.doc[some]
    hashes, docs = [K.word_hashes(data, K.Words(start, end, doc, np.zeros(0, int)))], [doc]
    for n in PREFIXES:
        longer = end - start > n
        hashes.append(K.word_hashes(data, K.Words(start[longer], start[longer] + n, doc[longer], np.zeros(0, int))) ^ np.uint64(n))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


def features(texts: K.Texts, terms: np.ndarray) -> np.ndarray:
    """Presence of each term, and a last column of 1."""
    out = np.zeros((texts.n, len(terms) + 1), dtype=np.float32)
    out[:, -1] = 1
    h, doc = terms_of(texts)
    if len(terms) and len(h):
        i = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[i] == h
        out[doc[hit], i[hit]] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """Ridge logistic regression, ``y`` of ``n`` alike rows positive; the last column (bias) is not penalised.  Without a positive row: never.

    Newton steps that keep a curvature as long as each step is less than half the one before.
    """
    w = np.zeros(x.shape[1])
    if not y.any():
        w[-1] = -30.0
        return w
    if start is not None and abs(start[-1]) < 20:
        w = start.copy()
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    inverse, last, single = None, 0.0, x.astype(np.float32)  # enough for a curvature
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - n * p) - penalty * w
        step = None if inverse is None else inverse @ slope
        if step is None or np.abs(step).max() > last / 2:
            v = (n * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)
            inverse = np.linalg.inv(((single * v[:, None]).T @ single).astype(np.float64) + np.diag(penalty))
            step = inverse @ slope
        w += step
        last = np.abs(step).max()
        if last < 1e-9:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _with(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x[:, :-1], *(e[:, None] for e in earlier), x[:, -1:]], axis=1)


def kinds_of(bits: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A cluster for each row by k-means, numbered by size; starts from the row with most bits and those farthest from the ones before."""
    if not len(bits):
        return np.zeros(0, np.int64)
    x = bits.astype(np.float64)
    far = lambda centres: ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    centres = x[[int(x.sum(axis=1).argmax())]]
    while len(centres) < KINDS:
        centres = np.concatenate([centres, x[[int(far(centres).min(axis=1).argmax())]]])
    for _ in range(rounds):
        own = far(centres).argmin(axis=1)
        centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(KINDS)])
    size = np.bincount(own, minlength=KINDS)
    return np.argsort(np.argsort(-size, kind="stable"), kind="stable")[own]


def best_limit(p: np.ndarray, y: np.ndarray, n: np.ndarray, low: float = 0.15, high: float = 0.5) -> float:
    """The limit between ``low`` and ``high`` at which out-of-fold predictions have the best F1, the highest of ties."""
    best, limit = -1.0, high
    for t in np.linspace(high, low, 36):
        hit = p >= t
        f1 = 2 * y[hit].sum() / max(n[hit].sum() + y.sum(), 1)
        if f1 > best + 1e-12:
            best, limit = f1, float(t)
    return limit


def fit_chain(terms: np.ndarray, bits: np.ndarray, label: np.ndarray) -> Chain:
    """``bits``: presence of the terms in each labelled row; ``label``: 0 and 1.  Rows that are alike in a fold are fitted as one."""
    toxic = label > 0
    y = np.zeros((len(label), len(CHAIN)))
    y[toxic, kinds_of(bits[toxic])] = 1
    y[:, -1] = toxic
    fold = (np.arange(len(label)) % FOLDS)[:, None]
    alike, at = np.unique(np.concatenate([fold, bits], axis=1).astype(np.uint8), axis=0, return_inverse=True)
    at = at.reshape(-1)
    n = np.bincount(at, minlength=len(alike)).astype(float)
    fold, x = alike[:, 0], np.concatenate([alike[:, 1:], np.ones((len(alike), 1))], axis=1).astype(float)
    earlier, weights, limits = [], [], []
    for category in y.T:
        c = np.bincount(at, category, minlength=len(alike))
        z = _with(x, earlier)
        whole = logistic(z, c, n)
        out = np.zeros(len(alike))
        for f in range(FOLDS):
            test = fold == f
            if test.any() and not test.all():
                out[test] = _probability(z[test], logistic(z[~test], c[~test], n[~test], whole))
        weights.append(whole)
        limits.append(best_limit(out, c, n))
        earlier.append(out)
    return Chain(terms, weights, np.array(limits))


def probabilities(chain: Chain, texts: K.Texts) -> np.ndarray:
    """Rows x categories."""
    x = features(texts, chain.terms).astype(np.float64)
    out: list[np.ndarray] = []
    for w in chain.weights:
        out.append(_probability(_with(x, out), w))
    return np.stack(out, axis=1)


_COUNTS = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("toxic", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bits", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in CHAIN), ("is_toxic", pa.bool_())])


@lean
def _count_terms(batches):
    for b in batches:
        labels = np.asarray(b.column("label")).astype(np.int64)
        for first, last, part in K.slices(K.texts_of(b.column("text")), K.TABLE_BYTES):
            h, doc = terms_of(part)
            o = np.lexsort((h, doc))
            h, doc = h[o], doc[o]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[once], doc[once]
            known, code = np.unique(h, return_inverse=True)
            toxic = np.bincount(code, labels[first:last][doc], minlength=len(known)).astype(np.int64)
            yield batch(_COUNTS, known.view(np.int64), np.bincount(code, minlength=len(known)), toxic)


def _rows(shared):
    def run(batches):
        for b in batches:
            for first, last, part in K.slices(K.texts_of(b.column("text"))):
                x = features(part, shared.value)[:, :-1].astype(np.uint8)
                own = slice(first, last)
                yield batch(_ROWS, b.column("doc_id")[own], b.column("label")[own].cast(pa.int32()), [row.tobytes() for row in np.packbits(x, axis=1)])

    return lean(run)


def telling_terms(counts: DataFrame, n: int, total: int) -> DataFrame:
    """The ``TERMS`` terms with the largest log-likelihood ratio for toxic texts, of those that are more frequent there."""
    rate = (total + 0.5) / (n + 1)
    a, df = F.col("toxic"), F.col("df")
    inside = (a + 0.1 * rate) / (df + 0.1)
    gain = a * F.log(F.greatest(inside, F.lit(1e-12)) / rate) + (df - a) * F.log(F.greatest(1 - inside, F.lit(1e-12)) / (1 - rate))
    told = counts.where(F.col("df") >= MIN_DOCS).withColumn("gain", F.when(inside > rate, gain).otherwise(0.0))
    return told.where("gain > 0").orderBy(F.desc("gain"), "term").limit(TERMS).select("term")


def _score(shared):
    def run(batches):
        for b in batches:
            for first, last, part in K.slices(K.texts_of(b.column("text"))):
                p = probabilities(shared.value, part)
                yield batch(_OUT, b.column("doc_id").slice(first, last - first).cast(pa.int64()), *p.T, p[:, -1] >= shared.value.limits[-1])

    return lean(run)


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Chain:
    """The chain, from at most ``limit`` labelled rows.

    Terms are counted and chosen in Spark; the driver gets the chosen ones and a bit
    for each of them of every labelled row.
    """
    texts = stored(labelled_texts(docs, labels, "toxic", limit), "labelled")
    counts = texts.mapInArrow(_count_terms, "term long, df long, toxic long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))
    n, positive = texts.agg(F.count("*"), F.sum("label")).first()
    terms = np.sort(np.array([r.term for r in telling_terms(counts, n, positive or 0).collect()], dtype=np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = texts.mapInArrow(_rows(shared), "doc_id long, label int, bits binary")
    known = rows.orderBy(F.xxhash64("doc_id"), "bits").limit(limit).toArrow()
    bits = np.zeros((known.num_rows, len(terms)), np.uint8)
    if len(terms) and known.num_rows:
        packed = np.frombuffer(b"".join(known.column("bits").to_pylist()), np.uint8).reshape(known.num_rows, -1)
        bits = np.unpackbits(packed, axis=1)[:, : len(terms)]
    return fit_chain(terms, bits, np.asarray(known.column("label")))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """A probability for each category, and whether the last one reaches its limit, of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has no terms and gets the prior; texts of any length are scored whole; a
    probability at the limit counts as toxic.  Without labelled rows every probability is 0 and nothing is
    toxic.  Repeated and null doc_ids keep their rows and equal texts get equal
    probabilities; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit_toxicity(docs, labels, limit))
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", is_toxic boolean")
