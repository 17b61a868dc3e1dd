"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, scored by sharded count joins.

The model is of order ``ORDER`` over the bytes of UTF-8, so a gram is a number of
40 bits and no two grams meet.  Each document is scored by a model that has not
seen it: texts fall into ``FOLDS`` folds by a hash (equal texts into one), and model f
is counted over the trusted texts of the other folds.

Counting covers all trusted text: tasks count grams of their texts, grouped sums add
them, lower orders are counts of distinct left neighbours, and context totals, discounts and
weights come from grouped sums and joins, all dealt by gram.  Scoring goes by runs, the
partitions of the corpus: a run asks for the distinct grams of all orders that it has, once
each; these requests join the model's shards by gram; the answers meet again by run, in a file
of the shared folder; and a second look at the run's texts adds up their grams'
probabilities.  What is gathered grows with the corpus, a text never travels, and no
task holds more than one run's distinct grams.

A word model was ruled out by its disk: in a run of 26 MB of text, 2.6 of 4.1 million word
pairs are distinct and 1.6 million of them occur in trusted text, so that requests and answers
of pairs alone, pruned to those, take over twice the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import kernel as K
from spindle.llm.common import BROADCAST_ROWS, batch, lean, lean_group, prepare, semi_by_id, stored, table_path

ORDER = 5
SYMBOLS = 256
#: Models, each of the trusted texts of the other folds.
FOLDS = 2
#: Documents of a language are kept up to this quantile of its trusted documents' perplexity.
QUANTILE = 0.99
#: Symbols at a language's median that steady the perplexity of short texts.
SHORT = 60
#: A language with fewer trusted documents uses the quantile of all.
MIN_TRUSTED = 20
#: Bytes of text whose grams are counted before they are handed on; distinct requests that a run merges at once.
COUNT_BYTES = 16 << 20
MERGE = 1 << 20
#: A byte that UTF-8 never has stands before and after a text.
_BOUNDARY = 0xFF
_BITS = 8 * ORDER


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def _code(model, order, gram):
    """Key of a gram: model and order above its bytes."""
    return ((model * 8 + order) << _BITS) | gram


def grams_of(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte and at the end of each text, and n+1 offsets; a text has ORDER-1 boundaries before it and one behind."""
    n = np.diff(texts.bounds)
    at = np.concatenate([[0], np.cumsum(n + ORDER)])
    padded = np.full(int(at[-1]), _BOUNDARY, np.uint8)
    padded[np.arange(len(texts.data)) + np.repeat(at[:-1] + ORDER - 1 - texts.bounds[:-1], n)] = texts.data
    g = np.zeros(max(len(padded) - ORDER + 1, 0), np.uint64)
    for j in range(ORDER):
        g = (g << np.uint64(8)) | padded[j : len(padded) - ORDER + 1 + j]
    whole = np.ones(len(g), dtype=bool)
    whole[(at[1:-1, None] - np.arange(1, ORDER)[None, :]).reshape(-1)] = False  # windows over two texts
    return g[whole], np.concatenate([[0], np.cumsum(n + 1)])


def fold_of(text: str = "text"):
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")


def _coded(batches, order: int) -> Iterator[tuple[np.ndarray, int, pa.RecordBatch, int, int, np.ndarray]]:
    """(keys, bytes, batch, first row, last row, offsets) of each slice, with the fold of each text as its model."""
    for b in batches:
        folds = np.asarray(b.column("fold")).astype(np.uint64)
        for first, last, part in K.slices(K.texts_of(b.column("text"))):
            g, at = grams_of(part)
            yield np.repeat((folds[first:last] * np.uint64(8) + np.uint64(order)) << np.uint64(_BITS), np.diff(at)) | g, len(part.data), b, first, last, at


_COUNTS = pa.schema([("code", pa.int64()), ("n", pa.int64())])


@lean
def _count(batches):
    size, parts = 0, []

    def flush():
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        return batch(_COUNTS, code.view(np.int64), n)

    for code, length, *_ in _coded(batches, 0):
        parts.append(code)
        size += length
        if size >= COUNT_BYTES:
            yield flush()
            size, parts = 0, []
    if parts:
        yield flush()


def gram_counts(texts: DataFrame) -> DataFrame:
    """``(fold, gram, n)`` over all texts."""
    counted = texts.select("text", fold_of()).mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counted.select(F.shiftright("code", _BITS + 3).cast("int").alias("fold"), F.col("code").bitwiseAND(F.lit(_mask(ORDER))).alias("gram"), "n")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, kept within what leaves every share positive."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    each = ((1 - 2 * y * n2 / n1 if n1 else 0.5, 0.95), (2 - 3 * y * n3 / n2 if n2 else 1.0, 1.9), (3 - 4 * y * n4 / n3 if n3 else 1.5, 2.8))
    return tuple(min(max(v, 0.05), cap) for v, cap in each)


def order_counts(counts: DataFrame) -> DataFrame:
    """``(model, k, gram, n)``: counts of the highest order in the other folds, of lower ones the distinct left neighbours."""
    others = F.filter(F.array(*map(F.lit, range(FOLDS))), lambda m: m != F.col("fold"))
    now = stored(counts.select(F.explode(others).alias("model"), "gram", "n").groupBy("model", "gram").agg(F.sum("n").alias("n")), "grams")
    every = now.select("model", F.lit(ORDER).alias("k"), "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        now = now.select("model", F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).groupBy("model", "gram").agg(F.count("*").alias("n"))
        every = every.union(now.select("model", F.lit(k).alias("k"), "gram", "n"))
    return every


_MODEL = pa.schema([("key", pa.int64()), ("value", pa.int64())])


@lean
def _packed(batches):
    """Share and weight of a key as the halves of one number."""
    for b in batches:
        both = np.stack([np.asarray(b.column(c)).astype("<f4") for c in ("share", "weight")], axis=1)
        yield batch(_MODEL, b.column("key"), np.ascontiguousarray(both).view("<i8").reshape(-1))


def model_of(counts: DataFrame) -> DataFrame:
    """``(key, value)`` of every gram and context: its own share in its context, and the weight it gives, as a context, to the lower order."""
    spark = counts.sparkSession
    every = stored(order_counts(counts), "orders")
    kinds = every.groupBy("model", "k").agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5))).collect()
    given = [(r.model, r.k, *discounts(r.n1, r.n2, r.n3, r.n4)) for r in kinds]  # a row for each model and order
    small = F.broadcast(spark.createDataFrame(given, "model int, k int, d1 double, d2 double, d3 double"))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = every.join(small, ["model", "k"]).select("model", "k", "gram", "n", d.alias("d"), F.shiftright("gram", 8).alias("ctx"))
    contexts = rows.groupBy("model", "k", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("given"))
    key = lambda k, gram: F.call_function("shiftleft", (F.col("model") * 8 + k).cast("long"), F.lit(_BITS)).bitwiseOR(F.col(gram)).alias("key")
    none = F.lit(0.0)
    shares = rows.join(contexts, ["model", "k", "ctx"]).select(key(F.col("k"), "gram"), ((F.col("n") - F.col("d")) / F.col("total")).alias("share"), none.alias("weight"))
    weights = contexts.select(key(F.col("k") - 1, "ctx"), none.alias("share"), (F.col("given") / F.col("total")).alias("weight"))
    return shares.union(weights).groupBy("key").agg(F.max("share").alias("share"), F.max("weight").alias("weight")).mapInArrow(_packed, "key long, value long")


# --- scoring by runs ----------------------------------------------------------

_REQUESTS = pa.schema([("run", pa.int32()), ("key", pa.int64())])
_DONE = pa.schema([("run", pa.int32()), ("n", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("perplexity", pa.float64())])


def lower_keys(keys: np.ndarray) -> np.ndarray:
    """All keys that the probabilities of grams of the highest order ask for, sorted."""
    out, now = [keys], keys
    for k in range(ORDER - 1, -1, -1):
        gram = now & np.uint64(_mask(k + 1))
        own = (now >> np.uint64(_BITS + 3)) * np.uint64(8) + np.uint64(k) << np.uint64(_BITS)
        now = np.unique(own | gram & np.uint64(_mask(k)))
        out.append(np.union1d(now, own | gram >> np.uint64(8)))
    return np.sort(np.concatenate(out))


@lean
def _requests(batches):
    from pyspark import TaskContext

    run = TaskContext.get().partitionId()
    known, parts, size = np.zeros(0, np.uint64), [], 0
    for code, *_ in _coded(batches, ORDER):
        parts.append(np.unique(code))
        size += len(parts[-1])
        if size >= MERGE:
            known, parts, size = np.unique(np.concatenate([known, *parts])), [], 0
    keys = np.unique(np.concatenate([known, *parts]))
    if not len(keys):
        return
    keys = lower_keys(keys)
    for i in range(0, len(keys), 100_000):
        part = keys[i : i + 100_000]
        yield batch(_REQUESTS, np.full(len(part), run, np.int32), part.view(np.int64))


def _place(folder: str, run: int) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(f"{folder}/run-{run:08d}.grams")


def _answers(folder: str):
    """All answers to a run -> its file: sorted keys, then values, compressed."""

    def write(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        keys = np.asarray(table.column("key")).view(np.uint64)
        order = np.argsort(keys)
        values = np.asarray(table.column("value").fill_null(0))[order]
        steps = np.diff(keys[order], prepend=np.uint64(0))
        data = zstandard.ZstdCompressor(level=3).compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + values.astype("<i8").tobytes())
        fs, path = _place(folder, run)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}"  # a repeated task writes the same again
        with fs.open_output_stream(own) as sink:
            sink.write(data)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            fs.move(own, path)
        else:
            fs.delete_file(own)
        return pa.Table.from_batches([batch(_DONE, [run], [len(keys)])], schema=_DONE)

    return lean_group(write)


def _answered(folder: str, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of a run, shares, weights."""
    fs, path = _place(folder, run)
    with fs.open_input_stream(path) as source:
        raw = zstandard.ZstdDecompressor().decompress(source.read())
    n = len(raw) // 16
    steps = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T.copy().view("<u8").reshape(-1)
    both = np.frombuffer(raw, "<f4", 2 * n, 8 * n).reshape(n, 2).astype(np.float64)
    return np.cumsum(steps, dtype=np.uint64), both[:, 0], np.where(both[:, 1] > 0, both[:, 1], 1.0)  # an unseen context leaves all to the lower order


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    if not len(keys) or (keys[i] != wanted).any():
        raise RuntimeError("a run of the corpus holds other texts than when it was counted")
    return i


def log_probabilities(keys: np.ndarray, share: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the highest order and the log2 probability of each gram's last symbol."""
    top = keys[(keys >> np.uint64(_BITS)) & np.uint64(7) == ORDER]
    model = top >> np.uint64(_BITS + 3)
    p = np.full(len(top), 1.0 / SYMBOLS)
    for k in range(1, ORDER + 1):
        gram = top & np.uint64(_mask(k))
        own = _found(keys, (model * np.uint64(8) + np.uint64(k) << np.uint64(_BITS)) | gram)
        ctx = _found(keys, (model * np.uint64(8) + np.uint64(k - 1) << np.uint64(_BITS)) | gram >> np.uint64(8))
        p = share[own] + weight[ctx] * p
    return top, np.log2(p)


def _score(folder: str):
    def run(batches):
        from pyspark import TaskContext

        known = None
        for code, _, b, first, last, at in _coded(batches, ORDER):
            if known is None:
                known = log_probabilities(*_answered(folder, TaskContext.get().partitionId()))
            sums = np.concatenate([[0.0], np.cumsum(known[1][_found(known[0], code)])])
            n = np.diff(at)
            keep = slice(first, last)
            yield batch(_SCORES, b.column("doc_id")[keep].cast(pa.int64()), b.column("lang")[keep], n, np.exp2(-(sums[at[1:]] - sums[at[:-1]]) / n))

    return lean(run)


def _repeatable(rows: DataFrame) -> DataFrame:
    """Rows whose partitions hold the same texts each time: a plain scan as it is, anything shuffled after it was written."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:  # else executors that come or go change how files are cut
        conf.set("spark.sql.files.minPartitionNum", str(rows.sparkSession.sparkContext.defaultParallelism))
    return stored(rows, "texts") if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity)`` of every row, by models of the texts of ``trusted`` that have not seen the row's."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    model = stored(model_of(gram_counts(trusted)), "model")
    rows = _repeatable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"))
    requests = rows.select("text", fold_of()).mapInArrow(_requests, "run int, key long")
    folder = table_path(spark, "answers")
    answers = requests.join(model, "key", "left").groupBy("run").applyInArrow(_answers(folder), "run int, n long")
    stored(answers, "answered")
    return rows.select("doc_id", "lang", "text", fold_of()).mapInArrow(_score(folder), "doc_id long, lang string, n_symbols long, perplexity double")


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity, steadied, limit, kept)`` of every row of ``docs(doc_id, text, lang, ...)``.

    Trusted: rows that ``labels`` gives quality 1.  Perplexity is that of a symbol (a byte or a text's
    end).  What is compared with the limit is steadied: as if ``SHORT`` symbols at the
    language's median came with the text, since a few words say little.  A null or empty text is one
    boundary symbol; texts of any length are scored whole; a text at the limit is kept.  A null language, and one with
    fewer than ``MIN_TRUSTED`` trusted documents, uses the limit of all languages; without trusted text
    the model is uniform and nothing is kept.  Repeated and null doc_ids keep their rows, and equal
    texts get equal perplexities; extra columns are ignored; an empty table gives an empty result.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    trusted = semi_by_id(docs.select("doc_id", "text"), good, "doc_id")
    scores = stored(perplexities(docs, trusted), "perplexities")
    median = _by_language(semi_by_id(scores, good, "doc_id"), "perplexity", 0.5)
    drawn = _with_limits(scores, median, "median")
    few = F.lit(float(SHORT))
    steadied = (F.log2("perplexity") * F.col("n_symbols") + F.log2("median") * few) / (F.col("n_symbols") + few)
    steady = stored(drawn.withColumn("steadied", F.coalesce(F.pow(F.lit(2.0), steadied), F.col("perplexity"))).drop("median"), "steadied")
    limits = _by_language(semi_by_id(steady, good, "doc_id"), "steadied", quantile)
    out = _with_limits(steady, limits, "limit")
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "steadied", "limit", F.coalesce(F.col("steadied") <= F.col("limit"), F.lit(False)).alias("kept"))


def _by_language(known: DataFrame, value: str, quantile: float) -> tuple[DataFrame, DataFrame]:
    """The quantile of all rows (one row), and of each language with ``MIN_TRUSTED`` of them."""
    q = F.percentile_approx(value, F.lit(quantile), F.lit(10_000))
    by_lang = known.where("lang IS NOT NULL").groupBy("lang").agg(q.alias("__own"), F.count("*").alias("__n")).where(F.col("__n") >= MIN_TRUSTED).drop("__n")
    return known.agg(q.alias("__all")), stored(by_lang, "limits")


def _with_limits(rows: DataFrame, limits: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
    every, by_lang = limits
    few = by_lang.count() <= BROADCAST_ROWS
    joined = rows.crossJoin(F.broadcast(every)).join(F.broadcast(by_lang) if few else by_lang, "lang", "left")  # one row beside each
    return joined.withColumn(name, F.coalesce("__own", "__all")).drop("__own", "__all")
