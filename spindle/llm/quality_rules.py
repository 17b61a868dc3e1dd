"""Quality rules: plain limits on document statistics, then boosted trees over them.

Statistics come from one pass of the text kernel.  The trees are fitted on at
most ``TRAIN_ROWS`` labelled rows (those first in hash order), flattened into node
arrays and applied to every document in the same pass.  More symbols, repeated
lines or repeated words never raise a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import batch, lean, prepare
from spindle.llm.trees import Trees, boosted

#: Labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_exclaim", "n_pipe", "n_digits")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "pipe_share", "digit_share", "line_words")
CONSTRAINTS = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0)


def _member(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_UPPER, _IS_DIGIT = _member(SYMBOLS), _member(bytes(range(65, 91))), _member(bytes(range(48, 58)))
_IS_HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


def _marked(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its document has it twice or more; whether it is not the first."""
    key = K.mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    later[order[1:][same]] = True
    return many, later


def statistics(texts: K.Texts) -> dict[str, np.ndarray]:
    """All counts of each document (null: zeros)."""
    data, bounds = texts.data, texts.bounds
    words = K.words_of(texts)
    n_words = np.diff(words.bounds)
    heads = np.concatenate([[0], np.cumsum(_IS_HEAD[data], dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(heads[words.end] - heads[words.start])])
    # lines: between line feeds and document bounds
    newline = data == 10
    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(newline) + 1]))
    starts = starts[starts < len(data)]
    inside = np.searchsorted(bounds, starts, side="right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(data)]]), bounds[inside + 1]) if len(starts) else starts
    ends = ends - (newline[ends - 1] & (ends > starts)) if len(starts) else ends
    has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    lines = K.Words(starts[has_word], ends[has_word], inside[has_word], np.zeros(0, int))
    _, later = _repeats(K.word_hashes(data, lines), lines.doc)
    # words inside any window that its document has twice
    windows, at = K.window_hashes(K.word_hashes(data, words), words.bounds, WINDOW, short=False)
    doc = np.repeat(np.arange(texts.n), np.diff(at))
    many, _ = _repeats(windows, doc)
    first = (words.bounds[doc] + np.arange(len(windows)) - at[doc])[many]
    cover = np.zeros(len(words.start) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    covered = np.cumsum(cover)[: len(words.start)] > 0
    return {
        "n_words": n_words, "word_chars": chars[words.bounds[1:]] - chars[words.bounds[:-1]], "n_symbols": _marked(_IS_SYMBOL[data], bounds),
        "n_dup_lines": np.bincount(lines.doc[later], minlength=texts.n), "n_repeat_words": _marked(covered, words.bounds),
        "n_chars": heads[bounds[1:]] - heads[bounds[:-1]], "n_lines": np.bincount(lines.doc, minlength=texts.n), "n_upper": _marked(_IS_UPPER[data], bounds),
        "n_exclaim": _marked(data == ord("!"), bounds), "n_pipe": _marked(data == ord("|"), bounds), "n_digits": _marked(_IS_DIGIT[data], bounds),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_exclaim"] / words, s["n_pipe"] / words, s["n_digits"] / chars, s["n_words"] / lines,
    ], axis=1).astype(np.float64)


_COUNT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), *((c, pa.int64()) for c in COUNTS)])
_SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS[:5]), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


@lean
def _count(batches):
    for b in batches:
        for first, last, part in K.slices(K.texts_of(b.column("text"))):
            s = statistics(part)
            yield batch(_COUNT_SCHEMA, *(b.column(c).slice(first, last - first) for c in ("doc_id", "label")), *(s[c] for c in COUNTS))


def _score(model: Trees, at_least: float):
    def run(batches):
        for b in batches:
            for first, last, part in K.slices(K.texts_of(b.column("text"))):
                s = statistics(part)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                p = 1 / (1 + np.exp(-model.raw(features(s))))
                yield batch(_SCORE_SCHEMA, b.column("doc_id").slice(first, last - first).cast(pa.int64()), *(s[c] for c in COUNTS[:5]), failed, ~failed & (p >= at_least), p)

    return lean(run)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``limit`` labelled rows, the first in hash order of doc_id: a fixed, bounded sample."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Trees:
    """The boosted trees, from statistics of at most ``limit`` labelled rows."""
    counted = labelled_texts(docs, labels, "quality", limit).mapInArrow(_count, "doc_id long, label int, " + ", ".join(f"{c} long" for c in COUNTS))
    rows = counted.orderBy(F.xxhash64("doc_id"), *COUNTS).limit(limit).toArrow()
    s = {c: np.asarray(rows.column(c)) for c in COUNTS}
    return boosted(features(s), np.asarray(rows.column("label")).astype(float), CONSTRAINTS)


def quality_rules(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, at_least: float = 0.5) -> DataFrame:
    """Statistics and verdict of every row of ``docs(doc_id, text, ...)``.

    A null text counts as empty, which the base rules fail; texts of any length count whole; a
    score at the limit is kept.  Repeated and null doc_ids keep their rows, and equal texts get equal
    verdicts; extra columns are ignored.  Without labelled rows of both classes the score is
    the prior alone; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    model = fit_rules(docs, labels, limit)
    return docs.select("doc_id", "text").mapInArrow(_score(model, at_least), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, score double")
