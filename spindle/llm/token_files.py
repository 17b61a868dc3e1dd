"""Token-id files: fixed blocks of ids, cut into byte planes, their bits transposed, each plane compressed on its own.

File layout (all integers little-endian)::

    magic  b"TPLN0001"
    chunks one after another
    index  n_chunks x (offset u64, n_ids u32, 4 plane lengths u32)
    docs   n_docs x (doc_id i64, flag u8: 1 if the id is null) then n_docs x n_tokens u64, one zstandard frame
    tail   index offset u64, n_chunks u64, docs offset u64, docs length u64, n_docs u64, n_ids u64, magic

A chunk holds ``CHUNK_IDS`` ids (the last one fewer).  Byte plane p of a chunk is
byte p of every id; a plane is bit-transposed before compression where that is
smaller, as a flag in the top bit of its length says; a plane of zeros has
length 0.  A chunk can be read alone through the index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import batch, lean, partitions, prepare, table_path

MAGIC = b"TPLN0001"
CHUNK_IDS = 1 << 16
LEVEL = 3
_BITS = 1 << 31
_TAIL = struct.Struct("<6Q8s")
_ENTRY = np.dtype([("offset", "<u8"), ("n_ids", "<u4"), ("planes", "<u4", (4,))])
END_ID = 2
#: Pieces that an encoder remembers, texts that it hands to the library at once, bytes of text that it cuts at once.
CACHE_PIECES = 1_000_000
ENCODE_TEXTS = 4096
ENCODE_BYTES = 1 << 20
#: Characters by which rows of one doc_id are ordered before a hash decides.
TIE_CHARS = 64


# --- the format ---------------------------------------------------------------


def transpose_bits(plane: np.ndarray) -> np.ndarray:
    """Bit b of all bytes together, for b from 7 to 0; the length is padded to a multiple of 8 bytes."""
    padded = np.zeros(-(-len(plane) // 8) * 8, np.uint8)
    padded[: len(plane)] = plane
    return np.packbits(np.unpackbits(padded).reshape(-1, 8).T.copy().reshape(-1))


def restore_bits(bits: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(np.unpackbits(bits).reshape(8, -1).T.copy().reshape(-1))[:n]


def encode_chunk(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> tuple[bytes, list[int]]:
    planes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    out, lengths = [], []
    for p in range(4):
        plane = np.ascontiguousarray(planes[:, p])
        if not plane.any():
            lengths.append(0)
            continue
        plain = compressor.compress(plane.tobytes())
        turned = compressor.compress(transpose_bits(plane).tobytes())
        out.append(min(plain, turned, key=len))
        lengths.append(len(out[-1]) | (_BITS if out[-1] is turned else 0))
    return b"".join(out), lengths


def decode_chunk(data: bytes, lengths, n: int) -> np.ndarray:
    planes = np.zeros((n, 4), np.uint8)
    at, d = 0, zstandard.ZstdDecompressor()
    for p, coded in enumerate(int(x) for x in lengths):
        size = coded & (_BITS - 1)
        if size:
            raw = np.frombuffer(d.decompress(data[at : at + size]), np.uint8)
            planes[:, p] = restore_bits(raw, n) if coded & _BITS else raw
            at += size
    return planes.reshape(-1).view("<u4")


class TokenFileWriter:
    """Writes documents in the order given; memory is one chunk and 17 bytes a document."""

    def __init__(self, sink, chunk_ids: int = CHUNK_IDS, level: int = LEVEL):
        self.sink, self.chunk_ids = sink, chunk_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.entries: list[tuple] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), null.astype(np.uint8), lengths.astype("<u8")))
        self.waiting.append(ids.astype("<u4"))
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.chunk_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        i = 0
        while len(ids) - i >= self.chunk_ids or (last and i < len(ids)):
            part = ids[i : i + self.chunk_ids]
            data, lengths = encode_chunk(part, self.compressor)
            self.sink.write(data)
            self.entries.append((self.at, len(part), tuple(lengths)))
            self.at += len(data)
            i += len(part)
        self.waiting, self.held = [ids[i:]], len(ids) - i

    def close(self) -> None:
        self._flush(True)
        index = np.array(self.entries, dtype=_ENTRY).tobytes()
        columns = [np.concatenate(c) if c else np.zeros(0, "<u8") for c in (zip(*self.docs, strict=True) if self.docs else ([], [], []))]
        docs = self.compressor.compress(b"".join(c.tobytes() for c in columns))
        self.sink.write(index + docs)
        n_docs = len(columns[0])
        self.sink.write(_TAIL.pack(self.at, len(self.entries), self.at + len(index), len(docs), n_docs, self.n_ids, MAGIC))


class TokenFileReader:
    """Reads the index and the document table, then chunks one by one."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if bytes(source.read_at(len(MAGIC), 0)) != MAGIC:
            raise ValueError("not a token file")
        self.index_at, n, docs_at, docs_len, self.n_docs, self.n_ids, magic = _TAIL.unpack(bytes(source.read_at(_TAIL.size, size - _TAIL.size)))
        if magic != MAGIC:
            raise ValueError("a token file without its end")
        self.index = np.frombuffer(source.read_at(n * _ENTRY.itemsize, self.index_at), dtype=_ENTRY)
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(docs_len, docs_at)) if docs_len else b""
        k = self.n_docs
        self.doc_ids = np.frombuffer(raw, "<i8", k)
        self.null = np.frombuffer(raw, np.uint8, k, 8 * k).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", k, 9 * k).astype(np.int64)

    def chunk(self, i: int) -> np.ndarray:
        e = self.index[i]
        size = int((e["planes"] & np.uint32(_BITS - 1)).sum())
        return decode_chunk(bytes(self.source.read_at(size, int(e["offset"]))), e["planes"], int(e["n_ids"]))

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn."""
        chunks = (self.chunk(i) for i in range(len(self.index)))
        held = np.zeros(0, "<u4")
        for n in self.lengths:
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(next(chunks))
                have += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield held[:n]
            held = held[n:]


# --- encoding -----------------------------------------------------------------


class Encoder:
    """Ids of whole texts.

    A byte-level tokenizer without normaliser always splits before a single blank
    between two characters that are no white space.  So each distinct piece
    between such blanks is encoded once by the library; up to ``CACHE_PIECES`` are
    remembered by a 64-bit hash, checked by length and ends, and their ids are
    gathered for all places of a slice.  Strings of added tokens in a text are these
    tokens, as in the library: texts are cut there first, and each part is a text
    of its own.  Texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # the longest of those that begin at one place
        self.added = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
        self.at_added = re.compile(b"|".join(map(re.escape, self.added)) or b"(?!)")
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_piece = kind == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.by_piece &= not any(t.single_word or t.lstrip or t.rstrip for t in added)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.checks, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.edges, self.n = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), 0

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for i in range(0, len(texts), ENCODE_TEXTS):  # an encoding holds much more than its ids
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + ENCODE_TEXTS], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *lengths])

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_plain``, for many short pieces: those without inner white space are encoded in lines of one text.

        A line feed between two such pieces is always a token of its own.
        """
        simple = [len(w := p.split()) == 1 and len(w[0]) >= len(p) - 1 and p.endswith(w[0]) and not self.at_added.search(p.encode()) for p in pieces]
        lines = [p for p, s in zip(pieces, simple, strict=True) if s]
        flat, _ = self._plain(["\n".join(lines[i : i + ENCODE_TEXTS]) + "\n" for i in range(0, len(lines), ENCODE_TEXTS)])
        ends = np.flatnonzero(flat == self.line_feed)
        if len(ends) != len(lines):
            return self._plain(pieces)
        lengths = np.zeros(len(pieces), np.int64)
        simple = np.array(simple, dtype=bool)
        lengths[simple] = np.diff(np.concatenate([[-1], ends])) - 1
        odd_ids, lengths[~simple] = self._plain([p for p, s in zip(pieces, simple, strict=True) if not s])
        out = np.zeros(int(lengths.sum()), np.uint32)
        own = np.repeat(simple, lengths)
        out[own], out[~own] = flat[flat != self.line_feed], odd_ids
        return out, lengths

    def _numbers(self, part: K.Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece in the pool; new ones are encoded."""
        data = part.data
        hashes = K.word_hashes(data, K.Words(start, end, start, start))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = start[first], end[first]
        checks = K.mix((b - a).astype(np.uint64) << np.uint64(32) | data[a].astype(np.uint64) << np.uint64(24) | data[b - 1].astype(np.uint64) << np.uint64(16) | data[(a + b) // 2].astype(np.uint64))
        if self.n + len(distinct) > CACHE_PIECES:
            self._forget()
        i = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        found = (self.hashes[i] == distinct) & (self.checks[i] == checks) if len(self.hashes) else np.zeros(len(distinct), bool)
        number = np.where(found, self.numbers[i], -1) if len(self.hashes) else np.full(len(distinct), -1)
        new = np.flatnonzero(~found)
        if len(new):
            ids, lengths = self._pieces([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(a[new], b[new], strict=True)])
            edge = int(self.edges[self.n])
            self.pool = _grown(self.pool.astype(np.uint32) if len(ids) and ids.max() > 0xFFFF else self.pool, edge + len(ids))
            self.edges = _grown(self.edges, self.n + len(new) + 1)
            self.pool[edge : edge + len(ids)] = ids
            self.edges[self.n + 1 : self.n + 1 + len(new)] = edge + np.cumsum(lengths)
            number[new] = np.arange(self.n, self.n + len(new))
            at = np.searchsorted(self.hashes, distinct[new])
            self.hashes, self.checks, self.numbers = (np.insert(x, at, v) for x, v in ((self.hashes, distinct[new]), (self.checks, checks[new]), (self.numbers, number[new])))
            self.n += len(new)
        return number[inverse]

    def _slice(self, part: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = part.data, part.bounds
        space = K._SPACE[data]
        split = data == 0x20
        split[1:] &= ~space[:-1]
        split[:-1] &= ~space[1:]
        tokens = self._added_in(part)
        for a, b in tokens:
            split[a:b] = False
        cuts = np.concatenate([bounds, np.array(tokens, dtype=np.int64).reshape(-1)])
        split[cuts[cuts > 0] - 1] = False  # not before a blank that ends a text
        split[cuts[cuts < len(data)]] = True  # a text begins a piece, and so does what follows an added token
        start = np.flatnonzero(split)
        end = np.append(start[1:], len(data))
        number = self._numbers(part, start, end)
        per = self.edges[number + 1] - self.edges[number]
        ends = np.cumsum(per)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.edges[number] - (ends - per), per) + np.arange(total)].astype(np.uint32) if total else np.zeros(0, np.uint32)
        edge = np.concatenate([[0], ends])
        at = np.searchsorted(start, bounds)
        return ids, edge[at[1:]] - edge[at[:-1]]

    def _added_in(self, part: K.Texts) -> list[tuple[int, int]]:
        """Places of added tokens within the texts."""
        raw = part.data.tobytes()
        if not any(t in raw for t in self.added):
            return []
        return [m.span() for a, b in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist(), strict=True) for m in self.at_added.finditer(raw, a, b)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text (null: none)."""
        if not self.by_piece:
            return self._plain(texts.fill_null("").to_pylist())
        parts = [self._slice(part) for _, _, part in K.slices(K.texts_of(texts), ENCODE_BYTES)]
        return np.concatenate([np.zeros(0, np.uint32), *(i for i, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker: what it remembers serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(lengths), end_id, np.uint32)
    ends = np.cumsum(lengths + 1) - 1
    keep = np.ones(len(out), dtype=bool)
    keep[ends] = False
    out[keep] = ids
    return out, lengths + 1


# --- Spark --------------------------------------------------------------------

_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _writer(folder: str, tokenizer: str, end_id: int, chunk_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"  # a repeated task writes another file; the manifest names one
        fs, path = _open(f"{folder}/{name}")
        encoder, writer, sink, n_docs = None, None, None, 0
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                encoder, sink = encoder_of(tokenizer), fs.open_output_stream(path)
                writer = TokenFileWriter(sink, chunk_ids)
            ids, lengths = with_end(*encoder.encode(b.column("text")), end_id)
            doc_ids = b.column("doc_id")
            writer.add(np.asarray(doc_ids.fill_null(0)), doc_ids.is_null().to_numpy(zero_copy_only=False), lengths, ids)
            n_docs += len(b)
        if writer is not None:
            writer.close()
            sink.close()
            yield batch(_MANIFEST, [part], [name], [n_docs], [writer.n_ids])

    return lean(run)


def _reader(folder: str):
    def run(batches):
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, path = _open(f"{folder}/{name}")
                with fs.open_input_file(path) as source:
                    r = TokenFileReader(source)
                    crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in r.documents()), np.int64, r.n_docs)
                starts = start + np.concatenate([[0], np.cumsum(r.lengths)])[:-1]
                for i in range(0, r.n_docs, 100_000):
                    j = min(i + 100_000, r.n_docs)
                    yield batch(_READ, pa.array(r.doc_ids[i:j], mask=r.null[i:j]), starts[i:j], r.lengths[i:j], crc[i:j])

    return lean(run)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, files: int | None = None) -> DataFrame:
    """Writes ``docs(doc_id, text, ...)`` in ascending doc_id order (null first) and returns the manifest.

    Rows of one doc_id, or without one, are ordered by the first ``TIE_CHARS`` characters of
    their text, then by a hash of it, and any number of them spreads over files.

    The manifest ``(part, file, n_docs, n_ids, start)`` has a row for each file,
    in order; ``start``: ids in all files before.  ``folder`` is a URI that every
    executor reaches.  A null or empty text is the end id alone.
    """
    prepare(docs.sparkSession)
    n = files or partitions(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, TIE_CHARS).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(n, "doc_id", "head", "hash", "row").sortWithinPartitions("doc_id", "head", "hash").select("doc_id", "text")
    manifest = ordered.mapInArrow(_writer(folder, tokenizer, end_id, chunk_ids), "part int, file string, n_docs long, n_ids long")
    path = table_path(docs.sparkSession, "manifest")
    manifest.write.parquet(path)
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return docs.sparkSession.read.parquet(path).withColumn("start", F.sum("n_ids").over(up_to) - F.col("n_ids"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files."""
    dealt = manifest.select("part", "file", "start").repartition(partitions(manifest.sparkSession), "part")
    return dealt.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes token files to the shared folder, reads them back and gives each document's digest.

    Every row of ``docs`` gets a row, repeated and null doc_ids too; extra columns
    are ignored; an empty table writes no file and gives an empty result.
    """
    folder = table_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
