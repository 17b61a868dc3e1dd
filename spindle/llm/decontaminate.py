"""Benchmark decontamination by q-gram lemma filtering.

Text and items are folded the same way (A-Z to lower case, runs of white space
to one blank).  An item is tested in windows of ``WINDOW`` bytes, one every
``STRIDE``, so that leaks of a part are found too, and as a whole if of up to
``WHOLE`` bytes.  The edit budget is ``EDITS`` of a pattern's bytes, rounded down; folded
items under ``EXACT`` bytes are tested without edits, and items under ``MIN_BYTES``
between word ends.  A region within ``k`` edits of a pattern of ``m`` bytes shares at
least ``m + 1 - q - k q`` of its q-grams (the q-gram lemma; q is 8, or 5 for items
under ``MIN_BYTES``), all on diagonals that differ by at most 2k.  Shared q-grams
are counted for each document and pattern, then in bands of two diagonal cells that
overlap by one; bands that meet the bound are verified by a banded alignment, for
all candidates of a slice at once.  A document's verdict rests on its own bytes alone.

Items are a query set: they go to every task in blocks of ``BLOCK_PATTERNS``
patterns.  One pass over the corpus tries up to ``PASS_BLOCKS`` blocks on each
batch of texts, of which a worker holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import batch, lean, prepare, stored

Q = 8
#: For folded items shorter than MIN_BYTES, which must also begin and end at word ends.
SHORT_Q = 5
MIN_BYTES = 32
#: Folded items shorter than this many bytes are tested without edits.
EXACT = 16
#: A verbatim part of WINDOW + STRIDE - 1 bytes holds a whole window.
WINDOW = 64
STRIDE = 16
#: Items up to this many bytes are tested as a whole too.
WHOLE = 192
#: Edits allowed, as a share of a pattern.
EDITS = 0.10
BLOCK_PATTERNS = 8192
#: Blocks of one pass over the corpus (16 MB each, on the disks of executors): half a million patterns.
PASS_BLOCKS = 64
_TABLE_BITS = 22
#: Bits that hold a start within an alignment's cost.
_START = 12
#: Bytes of words; a short item may not begin or end within one.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def folded(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their n+1 offsets and the place of each byte in the original."""
    data = K.lowered(texts.data)
    space = K._SPACE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = texts.bounds[:-1]
    keep[starts[starts < len(data)]] = True
    data = np.where(space, np.uint8(0x20), data)
    place = np.flatnonzero(keep)
    return data[place], np.searchsorted(place, texts.bounds), place


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram at each byte, as an integer (q of 8 bytes at most)."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    if q == 8:
        return np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()
    out = np.zeros(len(data) - q + 1, np.uint64)
    for j in range(q):
        out |= data[j : len(data) - q + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    return out


class Patterns(NamedTuple):
    """Patterns of one block of items, all of one q, and their sorted q-gram postings."""

    q: int
    data: np.ndarray  # patterns x longest, zero padded
    size: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    item: np.ndarray
    gram: np.ndarray  # distinct, sorted
    first: np.ndarray  # n+1 offsets into the postings
    pattern: np.ndarray
    at: np.ndarray
    seen: np.ndarray  # table of hashed grams


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


def patterns_of(items: Iterable[tuple[int | None, str]], edits: float = EDITS) -> Iterator[Patterns]:
    """Blocks of patterns of ``(item_id, text)``, one at a time; short items have blocks of their own."""
    waiting: dict[int, list[tuple[int | None, np.ndarray]]] = {Q: [], SHORT_Q: []}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        d, _, _ = folded(K.Texts(raw, np.array([0, len(raw)]), np.ones(1, bool)))
        d = np.frombuffer(d.tobytes().strip(b" "), np.uint8)
        if not len(d):
            continue
        q = SHORT_Q if len(d) < MIN_BYTES else Q
        cut = waiting[q]
        if len(d) <= WHOLE:
            cut.append((item, d))
        if len(d) > WINDOW:
            # the last two whole windows too, so that edits spread over twice a window leave few enough in one of them
            starts = {*range(0, len(d) - WINDOW, STRIDE), max(0, len(d) - 2 * WINDOW), len(d) - WINDOW}
            cut.extend((item, d[s : s + WINDOW]) for s in sorted(starts))
        while len(cut) >= BLOCK_PATTERNS:
            yield _block(cut[:BLOCK_PATTERNS], edits, q)
            del cut[:BLOCK_PATTERNS]
    for q, cut in waiting.items():
        if cut:
            yield _block(cut, edits, q)


def budget(size: np.ndarray, share: float, q: int) -> np.ndarray:
    """Edits allowed: the share of the size, rounded down; for shares beyond what the lemma can bound, as many as leave it one q-gram."""
    return np.where(size < EXACT, 0, np.minimum((size * share).astype(int), np.maximum(size - q, 0) // q))


def _block(cut: list[tuple[int | None, np.ndarray]], share: float, q: int = Q) -> Patterns:
    size = np.array([len(d) for _, d in cut])
    edits = budget(size, share, q)
    data = np.zeros((len(cut), int(size.max())), np.uint8)
    g, p, at = [], [], []
    for i, (_, d) in enumerate(cut):
        data[i, : len(d)] = d
        x = grams(d, q)
        g.append(x)
        p.append(np.full(len(x), i))
        at.append(np.arange(len(x)))
    g, p, at = np.concatenate(g), np.concatenate(p), np.concatenate(at)
    o = np.argsort(g, kind="stable")
    gram, first = np.unique(g[o], return_index=True)
    seen = np.zeros(1 << _TABLE_BITS, dtype=bool)
    seen[_slot(gram)] = True
    return Patterns(q, data, size, edits, size + 1 - q - edits * q, np.array([i for i, _ in cut], dtype=object), gram, np.append(first, len(g)), p[o], at[o], seen)


def aligned(text: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, width: int | np.ndarray, ps: Patterns, pattern: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each candidate's pattern against a region, within the diagonals ``low`` to ``low + width - 1``.

    Column c of row i stands for text place ``low + i + c``; bytes outside the
    candidate's document, ``first`` to ``last``, match nothing.  Returns the edits and the
    region's start and end, of equal ones the shortest; the whole pattern is aligned, the text's ends are
    free, or with ``ends`` at places of the text where that is true.
    """
    width = np.broadcast_to(width, len(low))
    n, cols = len(low), np.arange(int(width.max(initial=1)), dtype=np.int32)
    outside = cols[None, :] >= width[:, None]
    padded_rows, big, one = bool(outside.any()), np.int32(1 << 30), np.int32(1 << _START)
    size = ps.size[pattern]
    rows = int(size.max()) if n else 0
    # a cost is edits, then how far the start lies from the last column
    row = np.where(outside, big, (len(cols) - 1 - cols)[None, :]).astype(np.int32)

    def barred(which, i):
        """Columns of row i where no region may begin or end."""
        x = low[which, None] + i + cols[None, :]
        return ~(ends[np.clip(x, 0, len(text))] & (x >= first[which, None]) & (x <= last[which, None]))

    if ends is not None and n:
        row[barred(np.arange(n), 0)] = big
    best, start, end = np.full(n, 1 << 18), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    place = low[:, None] + np.arange(rows + len(cols))[None, :]
    inside = (place >= first[:, None]) & (place < last[:, None])
    region = np.where(inside, text[np.clip(place, 0, max(len(text) - 1, 0))], np.int16(-1)) if n else place
    own = ps.data[pattern].astype(np.int16)
    skip = np.full(row.shape, big, np.int32)
    for i in range(1, rows + 1):
        match = row + (region[:, i - 1 : i - 1 + len(cols)] != own[:, i - 1, None]) * one  # column c matches the text byte low + i + c - 1
        skip[:, :-1] = row[:, 1:] + one  # a pattern byte without a text byte
        row = np.minimum(match, skip) - cols * one
        row = np.minimum.accumulate(row, axis=1) + cols * one  # text bytes without a pattern byte
        if padded_rows:
            row[outside] = big
        done = size == i
        if done.any():
            own_row = row[done]
            if ends is not None:
                own_row[barred(np.flatnonzero(done), i)] = big
            c = own_row.argmin(axis=1)
            cost = own_row[np.arange(len(c)), c]
            best[done] = cost >> _START
            start[done] = low[done] + len(cols) - 1 - (cost & (one - 1))
            end[done] = low[done] + i + c
    return best, np.maximum(start, first), np.minimum(end, last)


def word_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place between bytes, and both ends, whether no word goes on across it."""
    word = _WORD[data]
    out = np.ones(len(data) + 1, dtype=bool)
    out[1:-1] = ~(word[1:] & word[:-1])
    out[bounds] = True
    return out


def _tiny_leaks(data: np.ndarray, bounds: np.ndarray, ps: Patterns, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, pattern, start, end, 0) of items that are shorter than a q-gram."""
    out: list[tuple[int, int, int, int, int]] = []
    tiny = np.flatnonzero(ps.size < ps.q)
    whole = data.tobytes() if len(tiny) else b""
    for p in tiny.tolist():
        size, at, found = int(ps.size[p]), -1, []
        word = ps.data[p, :size].tobytes()
        while (at := whole.find(word, at + 1)) >= 0:
            found.append(at)
        start = np.array(found, dtype=np.int64)
        doc = np.searchsorted(bounds, start, side="right") - 1
        ok = (start + size <= bounds[doc + 1]) & ends[start] & ends[start + size]
        out.extend((d, p, x, x + size, 0) for d, x in zip(doc[ok].tolist(), start[ok].tolist(), strict=True))
    return out


def _candidates(data: np.ndarray, bounds: np.ndarray, ps: Patterns) -> tuple[np.ndarray, ...]:
    """(document, pattern, lowest diagonal, width) of the bands that hold as many shared q-grams as the lemma asks for."""
    none = (np.zeros(0, np.int64),) * 4
    g = grams(data, ps.q)
    if not len(g) or not len(ps.gram):
        return none
    hit = np.flatnonzero(ps.seen[_slot(g)])
    i = np.minimum(np.searchsorted(ps.gram, g[hit]), len(ps.gram) - 1)
    ok = ps.gram[i] == g[hit]
    doc = np.searchsorted(bounds, hit, side="right") - 1
    ok &= hit + ps.q <= bounds[doc + 1]
    hit, i, doc = hit[ok], i[ok], doc[ok]
    if not len(hit):
        return none
    many = ps.first[i + 1] - ps.first[i]
    at = np.repeat(ps.first[i] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    pattern, doc = ps.pattern[at], np.repeat(doc, many)
    diagonal = np.repeat(hit, many) - ps.at[at]
    pair = doc * len(ps.size) + pattern
    pairs, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (total >= ps.bound[pairs % len(ps.size)])[inverse]
    pair, pattern, diagonal = pair[enough], pattern[enough], diagonal[enough]
    if not len(pair):
        return none
    cell = 2 * ps.edits[pattern] + 1
    offset = len(data) + 4 * WHOLE  # diagonals may be negative
    cells, count = np.unique(pair * (2 * offset) + (diagonal + offset) // cell, return_counts=True)
    after = np.minimum(np.searchsorted(cells, cells + 1), len(cells) - 1)
    two = count + np.where(cells[after] == cells + 1, count[after], 0)
    p = (cells // (2 * offset)) % len(ps.size)
    good = two >= ps.bound[p]
    cells, p = cells[good], p[good]
    step = 2 * ps.edits[p] + 1
    low = (cells % (2 * offset)) * step - offset - ps.edits[p]
    return cells // (2 * offset) // len(ps.size), p, low, 2 * step + 2 * ps.edits[p]


def leaks(texts: K.Texts, ps: Patterns) -> list[tuple[int, int | None, int, int, int]]:
    """(document, item, start byte, end byte, edits) of regions that match a pattern."""
    data, bounds, place = folded(texts)
    ends = word_ends(data, bounds) if ps.q == SHORT_Q else None
    found = [] if ends is None else _tiny_leaks(data, bounds, ps, ends)
    doc, p, low, width = _candidates(data, bounds, ps)
    longer = ps.size[p] > WINDOW
    for some in (np.flatnonzero(~longer), np.flatnonzero(longer)):  # few calls, bands of different widths together
        for i in range(0, len(some), 512):
            m = some[i : i + 512]
            first, last = bounds[doc[m]], bounds[doc[m] + 1]
            edits, start, end = aligned(data, first, last, low[m], width[m], ps, p[m], ends)
            fine = (edits <= ps.edits[p[m]]) & (end > start)
            found.extend(zip(*(x[fine].tolist() for x in (doc[m], p[m], start, end, edits)), strict=True))
    own = texts.bounds
    return [(d, ps.item[x], int(place[a] - own[d]), int(place[b - 1] + 1 - own[d]), e) for d, x, a, b, e in found]


_SPAN = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(_SPAN))])


def _held(shared: Broadcast) -> Patterns:
    """A block, read from this executor's copy and not kept."""
    return shared.load_from_path(shared._path) if getattr(shared, "_path", None) else shared.value


def _in_batch(blocks: list[Broadcast], column: pa.Array) -> Iterator[tuple[int, int | None, int, int, int]]:
    """``leaks`` of all blocks in the texts of a batch, with rows of the batch."""
    texts = K.texts_of(column)
    for shared in blocks:
        block = shared.value if len(blocks) == 1 else _held(shared)
        for first, _, part in K.slices(texts):
            for d, *rest in leaks(part, block):
                yield first + d, *rest


def _search(blocks):
    def run(batches):
        for b in batches:
            found = [list(x) for x in b.column("spans").to_pylist()]
            for d, item, start, end, edits in _in_batch(blocks, b.column("text")):
                found[d].append({"item_id": item, "start": start, "end": end, "edits": edits})
            spans = [sorted(x, key=lambda s: (s["item_id"] is None, s["item_id"] or 0, s["start"], s["end"], s["edits"])) for x in found]
            yield batch(_OUT, b.column("doc_id"), b.column("text"), spans)

    return lean(run)


def _clean(blocks):
    def run(batches):
        for b in batches:
            keep = np.ones(len(b), dtype=bool)
            keep[[d for d, *_ in _in_batch(blocks, b.column("text"))]] = False
            yield b.filter(pa.array(keep))

    return lean(run)


def _through_blocks(rows: DataFrame, benchmark: DataFrame, edits: float, step: Callable) -> DataFrame:
    """Rows after one pass with all blocks, or a pass for each ``PASS_BLOCKS`` of them; only one block is on the driver at a time."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    context = rows.sparkSession.sparkContext
    shared = (context.broadcast(block) for block in patterns_of(((r.item_id, r.text) for r in items.toLocalIterator()), edits))
    for n, blocks in enumerate(batched(shared, PASS_BLOCKS)):
        if n:
            rows = stored(rows, "decontaminated")
        rows = rows.mapInArrow(step(blocks), rows.schema)
    return rows


def clean_documents(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` without any leaked region, with all their columns.

    Null and empty texts stay; rows that repeat stay or go alike; texts of any length
    are searched whole; an empty table gives an empty result, and without items all rows stay.
    Only the column ``text`` is looked at, whatever the others are called.
    """
    prepare(docs.sparkSession)
    return _through_blocks(docs, benchmark, edits, _clean)


def leaked_spans(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """``(doc_id, contaminated, item_ids, spans)`` of every row of ``docs(doc_id, text, ...)``.

    spans: byte ranges of the text that match a pattern of ``benchmark(item_id, text)``, with their edits;
    of alignments with equally few edits the shortest, of these the first.
    Null texts match nothing and null or blank items are found nowhere; items without
    an item_id are tested like others; without items nothing is contaminated.  Texts of any length are
    searched whole.  Repeated and null doc_ids keep their rows; extra columns are ignored.
    """
    prepare(docs.sparkSession)
    none = F.array().cast("array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.alias("spans"))
    found = _through_blocks(rows, benchmark, edits, _search)
    return found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), F.array_sort(F.array_distinct("spans.item_id")).alias("item_ids"), "spans")
