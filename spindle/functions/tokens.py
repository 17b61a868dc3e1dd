"""Byte-level BPE: pre-tokens in the JVM, merges in Arrow batches of distinct pre-tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spindle.ship import bounded, spread

#: Fixed value: the pre-token pattern.
PRE_TOKEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
#: Special tokens in the order in which they are added.
SPECIAL = ("<|im_start|>", "<|im_end|>", "<|vision_start|>", "<|vision_end|>", "<|video_start|>", "<|video_end|>")


def pre_tokens(text: Column, special: tuple[str, ...] = ()) -> Column:
    """Pieces of a text.  Special tokens are pieces of their own, and each part between them is cut as a text of its own."""
    pieces = lambda t: F.regexp_extract_all(t, F.lit(PRE_TOKEN), F.lit(0))
    if not special:
        return pieces(text)
    any_special = "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))
    parts = F.transform(F.split(text, any_special, -1), pieces)
    marks = F.regexp_extract_all(text, F.lit(f"({any_special})"), F.lit(1))
    return F.flatten(F.zip_with(parts, marks, lambda p, m: F.when(m.isNotNull(), F.array_append(p, m)).otherwise(p)))


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where it is one, else the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Merges by rank; what was encoded is remembered up to a bound.  Special tokens have their id whole."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], unknown: int | None = None, remember: int = 100_000, special: tuple[str, ...] = SPECIAL):
        self.ids, self.ranks, self.unknown, self.bound = vocabulary, {m: i for i, m in enumerate(merges)}, unknown, remember
        self.special = tuple(t for t in special if t in vocabulary)
        self.known: dict[str, list[int]] = {}

    def parts(self, piece: str) -> list[str]:
        """Symbols of a pre-token after all merges, the lowest rank first, everywhere at once."""
        letters = byte_letters()
        now = [letters[b] for b in piece.encode()]
        while len(now) > 1:
            pair = min(zip(now, now[1:], strict=False), key=lambda p: self.ranks.get(p, 1 << 60))
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(now):
                if i + 1 < len(now) and (now[i], now[i + 1]) == pair:
                    out.append(now[i] + now[i + 1])
                    i += 2
                else:
                    out.append(now[i])
                    i += 1
            now = out
        return now

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p not in self.known:
                if len(self.known) >= self.bound:
                    self.known.clear()
                parts = [p] if p in self.special else self.parts(p)
                self.known[p] = [i for i in (self.ids.get(s, self.unknown) for s in parts) if i is not None]
            out += self.known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        letters = {c: b for b, c in byte_letters().items()}
        names = {i: t for t, i in self.ids.items()}
        plain = lambda t: t.encode() if t in self.special else bytes(letters[c] for c in t)
        return b"".join(plain(names[i]) for i in ids if i in names).decode("utf-8", "replace")


def with_special(vocabulary: dict[str, int]) -> dict[str, int]:
    """A vocabulary with the special tokens that it lacks, numbered after its last id."""
    out = dict(vocabulary)
    for token in SPECIAL:
        out.setdefault(token, max(out.values(), default=-1) + 1)
    return out


def learned_merges(words: dict[str, int], n: int) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """A toy vocabulary for tests: the ``n`` most frequent pairs in turn, ties by text."""
    letters = byte_letters()
    now = {tuple(letters[b] for b in w.encode()): c for w, c in words.items()}
    merges: list[tuple[str, str]] = []
    for _ in range(n):
        pairs: dict[tuple[str, str], int] = {}
        for w, c in now.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        again: dict[tuple[str, ...], int] = {}
        for w, c in now.items():
            out, i = [], 0
            while i < len(w):
                two = i + 1 < len(w) and (w[i], w[i + 1]) == best
                out.append("".join(best) if two else w[i])
                i += 2 if two else 1
            again[tuple(out)] = again.get(tuple(out), 0) + c
        now = again
    vocabulary = {c: i for i, c in enumerate(letters.values())}
    for m in merges:
        vocabulary.setdefault("".join(m), len(vocabulary))
    return vocabulary, merges


def loaded(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary, with added tokens, and merges of a tokenizer file (JSON)."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model = read["model"]
    return model["vocab"] | {t["content"]: t["id"] for t in read.get("added_tokens", ())}, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


def encoded(df: DataFrame, text: str, bpe: Bpe, out: str = "ids") -> DataFrame:
    """``df`` with the ids of a text column.  Of each batch, which is bounded in bytes, every distinct piece is encoded once."""
    bounded(df.sparkSession)
    shared, columns = df.sparkSession.sparkContext.broadcast(bpe), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("pieces")
            flat = column.flatten().dictionary_encode()  # what null texts have is left out
            names = [shared.value.encode([p]) for p in flat.dictionary.to_pylist()]
            size = np.array([len(x) for x in names], dtype=np.int64)
            pool, first = np.fromiter((i for x in names for i in x), np.int32, int(size.sum())), np.cumsum(size) - size
            codes = np.asarray(flat.indices)
            many = size[codes]
            edges = np.concatenate([[0], np.cumsum(many)])
            ids = pool[np.repeat(first[codes] - edges[:-1], many) + np.arange(int(edges[-1]))]
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            made = pa.ListArray.from_arrays(pa.array(edges[ends].astype(np.int32)), pa.array(ids, pa.int32()), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*b.column("row").flatten(), made], names=columns)

    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    pieces = spread(df).select(row.alias("row"), pre_tokens(F.col(text), bpe.special).alias("pieces"))
    return pieces.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def with_eos(ids: Column, eos: int, pair: Column | None = None) -> Column:
    """Ids with an end id, unless they have one; the same after the second of a pair."""
    ended = lambda c: F.when(F.try_element_at(c, F.lit(-1)).eqNullSafe(F.lit(eos)), c).otherwise(F.array_append(c, F.lit(eos)))
    return F.concat(ended(ids), ended(pair)) if pair is not None else ended(ids)


def special_mask(ids: Column, special: list[int]) -> Column:
    return F.transform(ids, lambda i: F.when(i.isin(*special), 1).otherwise(0))


def sorted_merges(merges: dict[tuple[str, str], int]) -> list[str]:
    """Lines of a merges file, by rank."""
    return [f"{a} {b}" for (a, b), _ in sorted(merges.items(), key=lambda kv: kv[1])]
