"""Language identification with string kernels.

A text is cut into segments; a segment is the set of byte 1- to 3-grams it has,
over a vocabulary of the most common ones (blended spectrum, presence only).  The
kernel of two segments is the size of their intersection over the geometric mean
of their sizes.  ``LANDMARKS`` training segments give a Nyström feature map and
one-versus-rest kernel ridge regression the weights, so that scoring is two
matrix products for a batch of segments; a text's decision is the mean of its
segments', weighted by length.

Learned from at most ``TRAIN_PER_LANG`` rows of each language (one for each value of a
hash), ``TRAIN_SEGMENTS`` segments of each; with many languages from fewer rows of each, so
that about ``TRAIN_ROWS`` in all go to the driver, and of the ``MAX_LANGS`` most frequent at most.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import batch, lean, prepare, semi_by_id, stored

TRAIN_PER_LANG = 600
TRAIN_ROWS = 12_000
MAX_LANGS = 500
TRAIN_SEGMENTS = 4
SEGMENT = 1024
VOCABULARY = 4096
LANDMARKS = 160
RIDGE = 1e-2
#: Segments of one matrix product.
ROWS = 1024
UNKNOWN = "und"
#: Of the soft maximum that turns decisions into scores, and the score below which a filter rejects a text.
SHARPNESS = 4
MIN_SCORE = 0.3
_TABLE_BITS = 18
#: Characters of the Unicode categories of letters.
_LETTER = r"\p{L}"
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    langs: list[str]
    column: np.ndarray  # gram slot -> vocabulary column
    landmarks: np.ndarray  # vocabulary x landmarks, presence
    sizes: np.ndarray
    weights: np.ndarray  # landmarks x languages


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Slots of the 1-, 2- and 3-grams that start at each byte (the last n-1 left out)."""
    d = _FOLD[data].astype(np.uint32)
    mask = np.uint32((1 << _TABLE_BITS) - 1)
    out = [d]
    if len(d) > 1:
        out.append(((d[:-1] * np.uint32(0x9E3779B1) ^ d[1:] * np.uint32(0x85EBCA77) + np.uint32(977)) >> np.uint32(9)) & mask)
    if len(d) > 2:
        out.append(((d[:-2] * np.uint32(0x27D4EB2F) ^ d[1:-1] * np.uint32(0x165667B1) ^ d[2:] * np.uint32(0xC2B2AE3D) + np.uint32(31)) >> np.uint32(11)) & mask)
    return out


def segments_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of segments of nearly equal length, about ``SEGMENT`` bytes each."""
    size = np.diff(bounds)
    n = np.where(size > 0, np.maximum(1, size // SEGMENT), 0)
    doc = np.repeat(np.arange(len(size)), n)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return bounds[doc] + size[doc] * i // n[doc], bounds[doc] + size[doc] * (i + 1) // n[doc], doc


def presence(data: np.ndarray, start: np.ndarray, end: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0 and 1 over the vocabulary for consecutive segments of ``data``."""
    first, last = int(start[0]), int(end[-1])
    row = np.repeat(np.arange(len(start)), end - start)
    out = np.zeros((len(start), width + 1), dtype=np.float32)
    for n, slots in enumerate(_grams(data[first:last])):
        inside = row[: len(slots)] == row[n : n + len(slots)]
        out[row[: len(slots)], np.where(inside, column[slots], width)] = 1
    return out[:, :width]


def kernel_of(x: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (x @ landmarks) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] / np.sqrt(np.maximum(sizes, 1))[None, :]


_SEGMENTS = pa.schema([("lang", pa.string()), ("slot", pa.int64()), ("segment", pa.binary())])


@lean
def _sampled(batches):
    """Up to ``TRAIN_SEGMENTS`` segments of each text, evenly spaced."""
    for b in batches:
        texts = K.texts_of(b.column("text"))
        start, end, doc = segments_of(texts.bounds)
        n = np.bincount(doc, minlength=texts.n)
        before = np.cumsum(n) - n
        keep = [before[d] + i for d in range(texts.n) if n[d] for i in np.unique(np.linspace(0, n[d] - 1, min(n[d], TRAIN_SEGMENTS)).astype(int))]
        of = pa.array(doc[keep])
        yield batch(_SEGMENTS, b.column("lang").take(of), b.column("slot").take(of), [texts.data[start[i] : end[i]].tobytes() for i in keep])


def fit_model(segments: list[bytes], langs: list[str]) -> Model | None:
    """From a bounded list of labelled segments; None where there is nothing to learn."""
    if not segments:
        return None
    names = sorted(set(langs))
    data = [np.frombuffer(s, np.uint8) for s in segments]
    labels = [names.index(x) for x in langs]
    y = np.array(labels)
    found = np.zeros(1 << _TABLE_BITS, dtype=np.int64)
    for d in data:
        found[np.unique(np.concatenate(_grams(d)))] += 1
    width = min(VOCABULARY, int((found > 0).sum()))
    column = np.full(1 << _TABLE_BITS, width, dtype=np.int32)
    column[np.lexsort((np.arange(len(found)), -found))[:width]] = np.arange(width)

    def rows_of(chosen) -> np.ndarray:
        some = [data[i] for i in chosen]
        ends = np.cumsum([len(d) for d in some])
        return presence(np.concatenate(some), np.concatenate([[0], ends[:-1]]), ends, column, width)

    rng, chosen = np.random.default_rng(0), []
    for c in range(len(names)):  # as many landmarks of each language
        own = np.flatnonzero(y == c)
        chosen.extend(rng.permutation(own)[: max(1, LANDMARKS // len(names))])
    landmarks = rows_of(chosen).T.copy()
    sizes = landmarks.sum(axis=0)
    values, vectors = np.linalg.eigh(kernel_of(landmarks.T, landmarks, sizes).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))[None, :]
    # a row over the vocabulary takes 16 KB, so that only a block of them exists at a time
    phi = np.concatenate([kernel_of(rows_of(range(i, min(i + ROWS, len(y)))), landmarks, sizes) for i in range(0, len(y), ROWS)]) @ root
    target = np.where(y[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    share = np.bincount(y, minlength=len(names))[y]
    w = (1.0 / share)[:, None]  # languages count alike
    solved = np.linalg.solve(phi.T @ (phi * w) + RIDGE / len(y) * np.eye(phi.shape[1]), phi.T @ (target * w))
    return Model(names, column, landmarks, sizes, (root @ solved).astype(np.float32))


def decisions(model: Model, texts: K.Texts) -> np.ndarray:
    """A value for each text and language; zeros for an empty text."""
    out = np.zeros((texts.n, len(model.langs)))
    start, end, doc = segments_of(texts.bounds)
    for i in range(0, len(doc), ROWS):
        s = slice(i, i + ROWS)
        x = presence(texts.data, start[s], end[s], model.column, model.landmarks.shape[0])
        f = kernel_of(x, model.landmarks, model.sizes) @ model.weights
        np.add.at(out, doc[s], f * (end[s] - start[s])[:, None])
    return out / np.maximum(np.diff(texts.bounds), 1)[:, None]


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    letters = np.asarray(pc.match_substring_regex(texts, _LETTER).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
    if model is None or not len(letters):
        return [UNKNOWN] * len(letters), np.zeros(len(letters))
    f = np.concatenate([decisions(model, part) for _, _, part in K.slices(K.texts_of(texts))]) * SHARPNESS
    e = np.exp(f - f.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    names = np.array(model.langs, dtype=object)[best]
    return np.where(letters, names, UNKNOWN).tolist(), np.where(letters, p[np.arange(len(p)), best], 0.0)


def _predict(shared):
    def run(batches):
        for b in batches:
            names, score = predict(shared.value, b.column("text"))
            yield batch(_OUT, b.column("doc_id"), b.column("held_out"), names, score)

    return lean(run)


def _accepted(shared, at_least: float):
    def run(batches):
        for b in batches:
            names, score = predict(shared.value, b.column("text"))
            yield b.filter(pa.array([n != UNKNOWN for n in names]) if not at_least else pa.array([n != UNKNOWN and s >= at_least for n, s in zip(names, score, strict=True)]))

    return lean(run)


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_languages(docs: DataFrame) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``: never from rows that ``held_out`` names, or without lang or text."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(TRAIN_PER_LANG))
    drawn = stored(known.groupBy("lang", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "drawn")
    langs = [r.lang for r in drawn.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    per = max(TRAIN_ROWS // MAX_LANGS, min(TRAIN_PER_LANG, TRAIN_ROWS // max(len(langs), 1)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("slot"))  # of at most TRAIN_PER_LANG
    chosen = drawn.where(F.col("lang").isin(langs)).withColumn("place", place).where(F.col("place") <= per).select("lang", "slot", "doc_id")
    picked = semi_by_id(docs.select("doc_id", "text", "lang"), chosen.select("doc_id").distinct(), "doc_id").where(F.col("lang").isin(langs))
    one = picked.groupBy("lang", slot.alias("slot")).agg(F.min_by("text", F.struct("doc_id", F.length("text"))).alias("text"))
    rows = one.mapInArrow(_sampled, "lang string, slot long, segment binary").orderBy("lang", "slot", "segment").toArrow()
    return fit_model(rows.column("segment").to_pylist(), rows.column("lang").to_pylist())


def identify_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang, ...)``.

    ``und`` with score 0 for a text that is null or has no letter (Unicode category L),
    and for all where no language could be learned.  Ties go to the first language by code
    point; texts of any length are scored whole; repeated and null doc_ids keep their rows
    and get what others with their text get; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit_languages(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted_documents(docs: DataFrame, at_least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a language with a score of ``at_least``, with all their columns.

    Null and empty texts and those without a letter go, as do all where no language
    could be learned; rows that repeat stay or go alike; doc_id and columns of any
    other name have no say; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    return docs.mapInArrow(_accepted(spark.sparkContext.broadcast(fit_languages(docs)), at_least), docs.schema)
