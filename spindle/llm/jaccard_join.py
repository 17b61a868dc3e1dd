"""Exact n-gram Jaccard self-join by a size-aware heavy-light scheme, down to connected components.

Two sets of shingles with sizes n and m have Jaccard similarity of at least
t percent exactly when they share ``o(n, m) = ceil(t (n + m) / (100 + t))``
members.

* *Equal sets* are one vertex: a grouped minimum over a 64-bit signature
  (a wrapping sum of mixed members) and the size.
* *Light sets* (size up to a boundary) enumerate all their subsets of the fixed
  size o(n, m) for every partner size m; sets that share such a subset are
  linked without any further check.
* *Heavy sets* scan inverted lists.  A list is kept for each of a set's first
  ``n - ceil(t n / 100) + 1`` members in one global order, rare before common:
  any linked pair shares a list.  The order only needs to be the same for all
  sets; how well it tells rare from common affects speed, never the result.
  A first pass finds keys that occur twice, and a bitmap of bounded size keeps
  the postings of others from being written.  Lists with the same members are
  scanned once.  Short lists give candidate pairs, at most ``SHORT_LIST`` / 2 for
  a list entry; long lists connect the sets of compatible sizes.  What candidates
  connect meets in groups (of large ones, each long list's pairs of blocks and
  each set with its partners): first sketches, the lowest part of each set, which
  exclude pairs exactly, then whole texts of what is left.  In a group, overlaps
  are counted from inverted lists in memory (or, where that is cheaper, by a
  matrix product) and a spanning forest of the links comes back, so a group of
  copies never becomes a table of pairs.
* The *boundary* is the largest size for which enumerating subsets costs less
  than scanning lists, by the mean length of the lists that the corpus has.

Broadcast: the most frequent shingles, ``COMMON`` at most (8 bytes each), and
ids behind a size check.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import batch, lean, lean_group, prepare, released, semi_by_id, stored
from spindle.llm.components import components

#: Candidate pairs come from lists of up to this many sets; longer lists are joined block by block.
SHORT_LIST = 16
#: Sets in a block of a long list; candidates that connect fewer than twice as many sets are checked in one group.
BLOCK = 1024
#: Shingles of one block at most, so that long texts make more blocks: a group of two blocks takes some 60 MB.
BLOCK_SHINGLES = 400_000
#: Rows of the join's tables for a set, roughly: only how many files they get follows from it.
SET_ROWS = 4
#: Subsets that a light set enumerates at most.
MAX_SUBSETS = 20_000
#: Bits of the filter that keeps postings of repeated keys only (32 MB).
FILTER_BITS = 1 << 28
#: The most frequent shingles that the global order knows, all others count as rare.
COMMON = 200_000
#: A shingle is a candidate for these if it is in this many documents of a run of COUNT_BYTES of text ...
COMMON_IN_RUN = 3
COUNT_BYTES = 8 << 20
#: ... and in this many documents by the sum of such runs.
COMMON_IN_ALL = 32


def overlap(n, m, percent: int):
    """Members that sets of sizes n and m must share."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n, percent: int):
    """Leading members of a set of size n of which any partner has at least one."""
    return n + ((-percent * n) // 100) + 1


def subset_cost(n: int, percent: int) -> int:
    """Subsets that a light set of size n enumerates, over all partner sizes."""
    return sum(comb(n, overlap(n, m, percent)) for m in range(-(-percent * n // 100), 100 * n // percent + 1) if overlap(n, m, percent) <= min(n, m))


def light_boundary(percent: int, partners: float) -> int:
    """Largest size up to which enumeration is cheaper than lists: postings plus checks of ``partners`` sets for each; no set has over ``MAX_SUBSETS``."""
    x = 0
    while subset_cost(x + 1, percent) <= min(MAX_SUBSETS, prefix_length(x + 1, percent) * (1 + partners * (x + 1))):
        x += 1
    return x


def mean_partners(lists: DataFrame, vertices: DataFrame, percent: int) -> float:
    """How many other sets a posting finds in its list: ``lists(key, count)`` has those of two sets and more."""
    found = lists.agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1))).first()[0] or 0.0
    postings = vertices.agg(F.sum(F.col("n") + F.floor(-percent * F.col("n") / 100) + 1)).first()[0] or 0
    return found / max(postings, 1)


def signature(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return K.mix(sums ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64())])
_COUNTS = pa.schema([("token", pa.int64()), ("df", pa.int64())])
_POSTINGS = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_KEYS = pa.schema([("key", pa.int64())])
_SKETCHES = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _sets(k: int):
    def run(batches):
        for b in batches:
            texts = K.texts_of(b.column("text"))
            ids = b.column("doc_id")
            for first, last, part in K.slices(texts):
                values, at = K.shingle_sets(part, k)
                n = np.diff(at)
                yield batch(_SETS, ids.slice(first, last - first).cast(pa.int64()), n, signature(K.sums_in_docs(K.mix(values), at), n))

    return lean(run)


def _common_in_runs(k: int, least: int):
    def counted(parts):
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        keep = counts >= least
        return batch(_COUNTS, values[keep].view(np.int64), counts[keep])

    def run(batches):
        parts, size, seen = [], 0, np.zeros(0, np.uint64)
        for b in batches:
            for _, _, part in K.slices(K.texts_of(b.column("text"))):
                values, at = K.shingle_sets(part, k)
                sums = K.sums_in_docs(K.mix(values), at)
                _, once = np.unique(sums, return_index=True)  # a run's equal sets count once
                once = once[~np.isin(sums[once], seen)]
                seen = np.concatenate([seen, sums[once]])
                chosen = np.zeros(part.n, dtype=bool)
                chosen[once] = True
                parts.append(values[np.repeat(chosen, np.diff(at))])
                size += len(part.data)
                if size >= COUNT_BYTES:
                    yield counted(parts)
                    parts, size, seen = [], 0, np.zeros(0, np.uint64)
        if parts:
            yield counted(parts)

    return lean(run)


def _light_keys(values: np.ndarray, percent: int, boundary: int):
    """(key, pos) of a light set: pos -1 where both partners have this size, -2 where the sizes differ."""
    n, mixed = len(values), K.mix(values)
    out = []
    for m in range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1):
        o = overlap(n, m, percent)
        if not m or o > min(n, m):
            continue
        chosen = np.array(list(combinations(range(n), o)), dtype=np.int64)
        salt = np.uint64(min(n, m) * 1_000_003 + max(n, m))
        keys = K.mix(K.mix(mixed[chosen].sum(axis=1, dtype=np.uint64)) + salt)
        out.append((keys, np.full(len(keys), -1 if n == m else -2, dtype=np.int32)))
    return out


def _postings(k: int, percent: int, boundary: int, common, bitmap, scan: bool = True):
    """Without a bitmap the keys alone; with one, whole postings of the keys it has.  ``scan``: not only the subsets of light sets."""

    def run(batches):
        order = np.asarray(common.value)  # rarest first
        known = np.argsort(order)
        ranked = order[known]
        for b in batches:
            for _, _, part in K.slices(K.texts_of(b.column("text"))):
                values, at = K.shingle_sets(part, k)
                n = np.diff(at)
                if not len(values):
                    continue
                sig = signature(K.sums_in_docs(K.mix(values), at), n)
                doc = np.repeat(np.arange(part.n), n)
                if len(ranked):
                    i = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
                    rank = np.where(ranked[i] == values, known[i] + 1, 0)
                    moved = np.zeros(part.n, dtype=bool)
                    moved[doc[rank > 0]] = True
                    m = np.flatnonzero(moved[doc])
                    values[m] = values[m[np.lexsort((values[m], rank[m], doc[m]))]]
                pos = np.arange(len(values)) - at[doc]
                scanned = scan & (100 * n // percent > boundary)  # some partner may be heavy
                keep = (pos < prefix_length(n, percent)[doc]) & scanned[doc]
                keys, sigs, sizes, places = [values[keep]], [sig[doc[keep]]], [n[doc[keep]]], [pos[keep]]
                for d in np.flatnonzero((n > 0) & (n <= boundary)):
                    for key, place in _light_keys(values[at[d] : at[d + 1]], percent, boundary):
                        keys.append(key)
                        sigs.append(np.full(len(key), sig[d]))
                        sizes.append(np.full(len(key), n[d]))
                        places.append(place)
                found = np.concatenate(keys).view(np.int64)
                if bitmap is None:
                    yield batch(_KEYS, found)
                    continue
                low = found & (64 * len(bitmap.value) - 1)
                hit = (bitmap.value[low >> 6] >> (low & 63)) & 1 == 1
                yield batch(_POSTINGS, found[hit], *(np.concatenate(c)[hit].astype(t) for c, t in ((sigs, np.int64), (sizes, np.int32), (places, np.int32))))

    return lean(run)


class _Forest:
    """Labels of sets that are connected so far, and the links that connected them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links ``i`` with one set of each label among the others that isn't its own."""
        labels, first = np.unique(self.label[others], return_index=True)
        for x, j in zip(labels.tolist(), others[first].tolist(), strict=True):
            if x != self.label[i]:
                self.links.append((i, j))
                self.label[self.label == x] = self.label[i]


class _Lists:
    """Inverted lists of sets given one after another (``doc`` ascending); ``shared(i)``: members that set i has in common with each earlier one."""

    def __init__(self, doc: np.ndarray, token: np.ndarray, n: int):
        by = np.argsort(token, kind="stable")
        self.doc = doc[by]
        first = np.concatenate([[0], np.cumsum(np.bincount(token))])
        self.first = first[token]  # of each member: where its list begins ...
        self.before = np.empty(len(token), np.int64)  # ... and how many earlier sets are in it
        self.before[by] = np.arange(len(token)) - first[token[by]]
        self.at = np.searchsorted(doc, np.arange(n + 1))

    def shared(self, i: int) -> np.ndarray:
        own = slice(self.at[i], self.at[i + 1])
        many = self.before[own]
        total = int(many.sum())
        if not total:
            return np.zeros(i, np.int64)
        place = np.repeat(self.first[own] - (np.cumsum(many) - many), many) + np.arange(total)
        return np.bincount(self.doc[place], minlength=i)


def forest_of(values: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets (distinct members each)."""
    n = np.diff(at)
    g = len(n)
    doc = np.repeat(np.arange(g), n)
    _, token, df = np.unique(values, return_inverse=True, return_counts=True)
    keep = df[token] > 1
    doc, token = doc[keep], token[keep]
    wide, token = np.unique(token, return_inverse=True)
    forest = _Forest(g)
    scan = float((np.bincount(token).astype(float) ** 2).sum()) / 2 if len(token) else 0.0
    dense = float(g) * g * len(wide) / 16

    def rows(i: int, shared: np.ndarray) -> None:
        j = np.flatnonzero(shared)
        j = j[100 * shared[j] >= percent * (n[i] + n[j] - shared[j])]
        if len(j):
            forest.join(i, j)

    if not len(token):
        return forest.links
    if dense <= scan and g * len(wide) <= 8 << 20:
        x = np.zeros((g, len(wide)), dtype=np.float32)
        x[doc, token] = 1
        for first in range(0, g, 256):
            counts = np.rint(x[first : first + 256] @ x.T).astype(np.int64)
            for i in range(first, min(first + 256, g)):
                rows(i, counts[i - first, :i])
    else:
        lists = _Lists(doc, token, g)
        for i in range(1, g):
            rows(i, lists.shared(i))
    return forest.links


def _group_links(k: int, percent: int):
    """All sets of one group -> a forest of their links."""

    def run(table: pa.Table) -> pa.Table:
        sigs = np.asarray(table.column("sig"))
        parts = [K.shingle_sets(p, k) for _, _, p in K.slices(K.texts_of(table.column("text")))]
        values = np.concatenate([v for v, _ in parts])
        n = np.concatenate([np.diff(a) for _, a in parts])
        at = np.concatenate([[0], np.cumsum(n)])
        own = signature(K.sums_in_docs(K.mix(values), at), n) == sigs  # else another text of the same doc_id
        once = np.unique(np.where(own, sigs, np.int64(0)), return_index=True)[1]
        once = np.sort(once[own[once]])
        keep = np.zeros(len(n), dtype=bool)
        keep[once] = True
        values, at, s = values[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]), sigs[once]
        links = np.array(forest_of(values, at, percent), dtype=np.int64).reshape(-1, 2)
        return pa.Table.from_batches([batch(_LINKS, s[links[:, 0]], s[links[:, 1]])], schema=_LINKS)

    return lean_group(run)


def sketch_size(n, percent: int):
    """Lowest members of a set of size n in its sketch: enough that unlike sets differ there by more than a linked pair may in all."""
    return np.minimum(n, (n * 1.85 * (100 - percent) / (100 + percent)).astype(np.int64) + 2)


def _sketches(k: int, percent: int):
    """The first 32 bits of each set's lowest members."""

    def run(batches):
        for b in batches:
            for _, _, part in K.slices(K.texts_of(b.column("text"))):
                values, at = K.shingle_sets(part, k)
                n = np.diff(at)
                sig = signature(K.sums_in_docs(K.mix(values), at), n)
                m = sketch_size(n, percent)
                low = (values >> np.uint64(32)).astype("<u4")
                yield batch(_SKETCHES, sig, n.astype(np.int32), [low[at[d] : at[d] + m[d]].tobytes() for d in range(part.n)])

    return lean(run)


def near_forest(sketches: list[np.ndarray], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that their sketches don't exclude.

    Up to the smaller of two sketches' largest members both sets are known; where
    they differ there by more members than a linked pair may in all, the pair is out.
    """
    sketches = [np.unique(s) for s in sketches]
    top = np.array([1 << 33 if len(s) == k or not len(s) else int(s[-1]) for s, k in zip(sketches, n, strict=True)])
    order = np.argsort(top, kind="stable")
    sketches, n, top = [sketches[o] for o in order], n[order], top[order]
    size = np.array([len(s) for s in sketches])
    _, token = np.unique(np.concatenate(sketches), return_inverse=True)
    lists, forest = _Lists(np.repeat(np.arange(len(n)), size), token, len(n)), _Forest(len(n))
    for i in range(1, len(n)):
        shared = lists.shared(i)
        differ = np.searchsorted(sketches[i], top[:i], side="right") + size[:i] - 2 * shared
        o = overlap(n[i], n[:i], percent)
        near = np.flatnonzero((o <= np.minimum(n[i], n[:i])) & (differ <= n[i] + n[:i] - 2 * o))
        if len(near):
            forest.join(i, near)
    return [(int(order[i]), int(order[j])) for i, j in forest.links]


def _group_near(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sigs = np.asarray(table.column("sig"))
        n = np.asarray(table.column("n")).astype(np.int64)
        sketches = [np.frombuffer(x, "<u4") for x in table.column("sketch").to_pylist()]
        links = np.array(near_forest(sketches, n, percent), dtype=np.int64).reshape(-1, 2)
        return pa.Table.from_batches([batch(_LINKS, sigs[links[:, 0]], sigs[links[:, 1]])], schema=_LINKS)

    return lean_group(run)


def shingle_sets(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, sig)`` of every row."""
    return docs.select("doc_id", "text").mapInArrow(_sets(words), "doc_id long, n_shingles long, sig long")


def _twice(keys: DataFrame, n: int) -> DataFrame:
    """``(key, count)`` of all keys that occur twice or more, in ``n`` sets."""
    return stored(keys.groupBy("key").count().where("count > 1"), "repeated", SET_ROWS * n)


def _bitmap(twice: DataFrame) -> np.ndarray:
    """The low bits of all keys, in at most ``FILTER_BITS`` bits."""
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * twice.count()).bit_length()))
    low = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = twice.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = words.toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return bitmap


def _blocks_for(size, total):
    """Blocks that so many sets with so many shingles are cut into."""
    return F.greatest(F.ceil(size / BLOCK), F.ceil(total / BLOCK_SHINGLES)).cast("int")


def _groups(edges: DataFrame, vertices: DataFrame, name: str, n: int) -> DataFrame:
    """``(sig, root, size, total, whole)`` of all ends of edges: their component, its sets and shingles, and whether it can be one group."""
    roots = components(edges, name, rows=SET_ROWS * n)
    grouped = roots.union(roots.select("root", "root").distinct())
    named = stored(grouped.select(F.col("vertex").alias("sig"), "root").join(vertices.select("sig", "n"), "sig"), "grouped", n)
    sized = named.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    out = stored(named.join(sized, "root").select("sig", "root", "size", "total", (_blocks_for(F.col("size"), F.col("total")) <= 2).alias("whole")), "groups", n)
    released(roots, named)
    return out


def _wholes(group: DataFrame) -> DataFrame:
    none = F.lit(-1)
    return group.where("whole").select(F.lit(0).alias("kind"), F.col("root").alias("key"), none.alias("i"), none.alias("j"), "sig")


def _blocks(entries: DataFrame, kind: int) -> DataFrame:
    """``(key, sig, size, total)`` -> a row for each pair of blocks of a key that an entry is in."""
    return (
        entries.withColumn("blocks", _blocks_for(F.col("size"), F.col("total")))
        .withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.lit(kind).alias("kind"), "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig")
    )


def _linked_by_lists(long_entries: DataFrame, percent: int) -> DataFrame:
    """Edges that connect all sets of compatible sizes in a list.  Compatible sizes lie in one size band or two adjacent ones.

    A list's sets are dealt to parts of about ``BLOCK``; each set is linked with the
    head of its part, heads of parts with the head of the band, so that no list of any length meets in one task.
    """
    band = F.floor(F.log("n") / float(np.log(100 / percent)))
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.col("size") / BLOCK)).cast("int")
    banded = long_entries.select("key", "sig", band.alias("band"), part.alias("part"))
    parts = banded.groupBy("key", "band", "part").agg(F.min("sig").alias("own"))
    heads = parts.groupBy("key", "band").agg(F.min("own").alias("head"))
    inside = banded.join(parts, ["key", "band", "part"]).select(F.col("own").alias("u"), F.col("sig").alias("v"))
    across = parts.join(heads, ["key", "band"]).select(F.col("head").alias("u"), F.col("own").alias("v"))
    up = heads.select("key", (F.col("band") + 1).alias("band"), F.col("head").alias("u")).join(heads, ["key", "band"]).select("u", F.col("head").alias("v"))
    return inside.union(across).union(up)


def jaccard_links(docs: DataFrame, vertices: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """A subset of all links ``(u, v)`` between signatures that connects whatever the links connect, and the tables it reads.

    ``vertices(sig, n, doc_id)``: one row of ``docs`` for each distinct set.
    """
    spark = docs.sparkSession
    many = vertices.count()
    texts = semi_by_id(docs.select("doc_id", "text"), vertices, "doc_id")
    counts = texts.select("text").mapInArrow(_common_in_runs(words, COMMON_IN_RUN), "token long, df long")
    common = counts.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= COMMON_IN_ALL).orderBy(F.desc("df"), "token").limit(COMMON)
    order = spark.sparkContext.broadcast(common.select("token").toArrow().column("token").to_numpy().view(np.uint64)[::-1].copy())
    # the boundary follows from the lists that all sets would have; subsets are then enumerated up to it
    listed = _twice(texts.select("text").mapInArrow(_postings(words, percent, 0, order, None), "key long"), many)
    boundary = light_boundary(percent, mean_partners(listed, vertices, percent))
    small = semi_by_id(docs.select("doc_id", "text"), vertices.where(F.col("n") <= boundary), "doc_id")
    subsets = _twice(small.select("text").mapInArrow(_postings(words, percent, boundary, order, None, False), "key long"), many)
    bitmap = spark.sparkContext.broadcast(_bitmap(listed.union(subsets).select("key")))
    released(listed, subsets)
    postings = stored(texts.select("text").mapInArrow(_postings(words, percent, boundary, order, bitmap), "key long, sig long, n int, pos int"), "postings")
    order.destroy()
    bitmap.destroy()

    lists = postings.groupBy("key").agg(
        F.count("*").alias("size"), F.min("sig").alias("head"), F.max("sig").alias("tail"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("kind"),
        F.sum(F.hash("sig").cast("long")).alias("members"), F.sum("n").alias("total"),
    ).where("head <> tail")
    lists = stored(lists, "lists", SET_ROWS * many)
    subsets = lists.where("kind = -1 OR (kind = -2 AND n0 < n1)").select("key", "head")
    by_subset = postings.where("pos < 0").join(subsets, "key").where("sig <> head").select(F.col("head").alias("u"), F.col("sig").alias("v"))
    scanned = lists.where("kind >= 0").groupBy("members", "size", "head", "tail").agg(F.min_by("key", "kind").alias("key"), F.max("total").alias("total"))  # the first in the global order: places bound what pairs share from there on
    entries = stored(postings.where("pos >= 0").join(scanned.select("key", "size", "total"), "key"), "entries", SET_ROWS * many)

    short = entries.where(F.col("size") <= SHORT_LIST)
    a, b = (short.select("key", *(F.col(c).alias(c + x) for c in ("sig", "n", "pos"))) for x in "ab")
    fits = (F.col("na") * 100 >= percent * F.col("nb")) & (F.col("nb") * 100 >= percent * F.col("na"))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    place = 1 + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= need
    pairs = stored(a.join(b, "key").where((F.col("siga") < F.col("sigb")) & fits & place).select(F.col("siga").alias("u"), F.col("sigb").alias("v")).distinct(), "pairs", SET_ROWS * many)
    long_entries = entries.where(F.col("size") > SHORT_LIST)

    # First sketches meet, in groups that bring all candidates together: whatever candidates connect,
    # or of larger groups each list's blocks and each set with its partners.
    group = _groups(pairs.union(_linked_by_lists(long_entries, percent)), vertices, "candidates", many)
    rest = group.where("NOT whole").select("sig")
    apart = pairs.join(rest.withColumnRenamed("sig", "u"), "u")
    none = F.lit(-1)
    sized = apart.join(vertices.select(F.col("sig").alias("v"), "n"), "v")
    counts = sized.groupBy("u").agg(_blocks_for(F.count("*"), F.sum("n")).alias("blocks"))
    dealt = sized.join(counts, "u").withColumn("i", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    partners = dealt.select("u", "i", F.explode(F.array("u", "v")).alias("sig")).distinct().select(F.lit(1).alias("kind"), F.col("u").alias("key"), "i", none.alias("j"), "sig")
    blocks = _blocks(long_entries.join(rest, "sig").select("key", "sig", "size", "total"), 2)
    members = stored(_wholes(group).union(partners).union(blocks), "members", SET_ROWS * many)
    released(group, entries)
    ids = vertices.select("sig", "doc_id")
    sketched = members.select("sig").distinct().join(ids, "sig")
    sketches = semi_by_id(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), (sketched := stored(sketched, "sketched", many)), "doc_id").select("text").mapInArrow(_sketches(words, percent), "sig long, n int, sketch binary").dropDuplicates(["sig"])
    near = sketches.join(members, "sig").groupBy("kind", "key", "i", "j").applyInArrow(_group_near(percent), "u long, v long")

    # Then whole texts, in groups of what the sketches left connected.
    group = _groups(near, vertices, "near", many)
    released(members, sketched, pairs)
    parts = group.where("NOT whole").select(F.col("root").alias("key"), "sig", "size", "total")
    members = stored(_wholes(group).union(_blocks(parts, 2)).join(ids, "sig"), "members", SET_ROWS * many)
    released(group)
    found = semi_by_id(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), members.select("doc_id").distinct(), "doc_id")
    checked = found.join(members, "doc_id").groupBy("kind", "key", "i", "j").applyInArrow(_group_links(words, percent), "u long, v long")
    return by_subset.union(checked), [postings, lists, members]


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    ``component_id``: the least doc_id that links reach.  A null or wordless
    text has an empty set and is its own component; a text of fewer words than a
    shingle is one shingle.  Rows that repeat a doc_id each get a row; rows
    without a doc_id get their set's component, but link nothing themselves.
    Extra columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sets = stored(shingle_sets(docs, words), "sets")
    vertices = stored(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n")), "vertices", sets.count())
    links, read = jaccard_links(docs, vertices, words, percent)
    roots = components(links, "links", rows=vertices.count())
    released(*read)
    labelled = vertices.join(roots, vertices.sig == roots.vertex, "left").select("sig", F.coalesce("root", "sig").alias("root"), "doc_id")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_sig = labelled.join(least, "root").select("sig", "component_id")
    return sets.join(by_sig, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component, with all their columns.

    Rows that share a doc_id count as one document, of which one row stays; rows
    without a doc_id all stay.
    """
    found = stored(jaccard_components(docs, words, percent), "components")
    known = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("kept"), F.count("*").alias("rows"))
    kept = stored(known.where("kept = 1").select("doc_id", "rows"), "kept", found.count())
    once = semi_by_id(docs, kept.where("rows = 1"), "doc_id")
    more = semi_by_id(docs, kept.where("rows > 1"), "doc_id").dropDuplicates(["doc_id"])
    columns = docs.columns
    return once.select(columns).union(more.select(columns)).union(docs.where("doc_id IS NULL"))
