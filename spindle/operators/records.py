"""Filters, joins and projections of records, their integrity and their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.det import below, uniform

#: Rows up to which a lookup side is broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted up to there)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# --- predicates ---------------------------------------------------------------------


def aesthetic_at_least(score: Column, least: float) -> Column:
    """Rows without a score pass."""
    return score.isNull() | (score >= least)


def covers_bucket(width: Column, height: Column, bucket_w: Column, bucket_h: Column) -> Column:
    return (width >= bucket_w) & (height >= bucket_h)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def not_black(std: Column, mean: Column) -> Column:
    """Not nearly black, of values in [-1, 1]."""
    return ~((std < 0.02) & (mean < -0.9))


def pixel_stats(values: Column) -> Column:
    """struct(mean, std) of an array (population)."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return F.struct(mean.alias("mean"), F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n).alias("std"))


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "") & (text != "none")


def normal_caption(abnormal: Column) -> Column:
    return ~F.coalesce(abnormal, F.lit(False))


def ratio_sane(target: Column, actual: Column, low: float = 0.7, high: float = 1.5) -> Column:
    return (target / actual).between(low, high)


def numbered_file(name: Column) -> Column:
    return name.rlike(r"^\d+\.png$")


def numbered_folder(name: Column) -> Column:
    return name.rlike(r"^\d+$")


def image_kind(data: Column) -> Column:
    """The format that a file's first bytes tell, else null."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def image_size(data: Column) -> Column:
    """struct(w, h) of a PNG, GIF or BMP from its header; null for other data."""
    number = lambda at, n: F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("int")
    turned = lambda at, n: F.conv(F.concat(*(F.hex(F.substring(data, at + n - 1 - i, 1)) for i in range(n))), 16, 10).cast("int")
    kind = image_kind(data)
    size = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    return F.when(kind == "png", size(number(17, 4), number(21, 4))).when(kind == "gif", size(turned(7, 2), turned(9, 2))).when(kind == "bmp", size(turned(19, 4), turned(23, 4)))


def first_image(*slots: Column, base64: bool = False) -> Column:
    """The bytes of the first slot that has any; of base64 text, what it stands for (null if it is none)."""
    first = F.coalesce(*slots)
    return F.try_to_binary(first, F.lit("base64")) if base64 else first


# --- runs of rejects -----------------------------------------------------------------


def reject_runs(rows: DataFrame, file: str, order: list[str], rejected: str) -> DataFrame:
    """``run``: how many rejects in a row end at each row of a file."""
    w = Window.partitionBy(file).orderBy(*order)
    group = F.sum(F.when(F.col(rejected), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__g", group).withColumn("run", F.sum(F.col(rejected).cast("int")).over(Window.partitionBy(file, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__g")


def until_breaker(rows: DataFrame, file: str, order: list[str], rejected: str, limit: int) -> DataFrame:
    """Accepted rows of a file up to where more than ``limit`` rejects come in a row: there the file is abandoned."""
    w = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    broken = reject_runs(rows, file, order, rejected).withColumn("__broken", F.max((F.col("run") > limit).cast("int")).over(w))
    return broken.where((F.col("__broken") == 0) & ~F.col(rejected)).drop("run", "__broken")


# --- joins -----------------------------------------------------------------------------


def caption_override(rows: DataFrame, captions: DataFrame, key: str, caption: str) -> DataFrame:
    """Rows that have an entry, with its caption."""
    return rows.drop(caption).join(captions.select(key, caption), key)


def aligned(main: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows of several tables by key; of columns that more than one has, the last table's value, if it has one."""
    out = main
    for other in others:
        both = [c for c in other.columns if c in out.columns and c != key]
        renamed = other.withColumnsRenamed({c: f"__{c}" for c in both})
        out = out.join(renamed, key).withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in both}).drop(*(f"__{c}" for c in both))
    return out


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row: what an alignment by key can't take."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def with_gold(pred: DataFrame, gold: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """Predictions with their gold rows; ``strict``: a prediction without one is an error."""
    if not strict:
        return pred.join(gold, on)
    marked = pred.join(gold.withColumn("__has", F.lit(True)), on, "left")
    return marked.withColumn("__has", F.coalesce(F.col("__has"), F.raise_error(F.lit("a prediction has no gold row")).cast("boolean"))).where("__has").drop("__has")


def with_default(rows: DataFrame, gold: DataFrame, key: str, column: str, default: str = "") -> DataFrame:
    """Rows with their gold value, or the default."""
    return rows.join(gold.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side in order, as far as the shorter table goes."""
    from spindle.operators.shard import numbered

    return numbered(left, *left_order).drop("n").join(numbered(right, *right_order).drop("n"), "position")


def last_write(rows: DataFrame, writes: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Rows with the last write to each key."""
    last = writes.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in columns))
    return rows.join(last, key, "left")


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def first_existing(rows: DataFrame, listing: DataFrame, name: str, folder: str, folder_order: str) -> DataFrame:
    """Rows whose file is in any folder, with the first folder in order."""
    found = listing.groupBy(name).agg(F.min_by(folder, folder_order).alias(folder))
    return rows.join(found, name)


def replaced_failures(rows: DataFrame, key: str, ok: str, seed: int) -> DataFrame:
    """Every row; one that failed takes the payload key of a valid row, chosen by hash: ``source_key``.

    Valid rows are numbered inside hash buckets, so nothing is gathered; an empty
    bucket falls to the first valid row.
    """
    buckets = 64
    good = rows.where(ok).select(F.col(key).alias("source_key")).withColumn("__b", F.pmod(F.xxhash64("source_key"), F.lit(buckets)).cast("int"))
    picked = good.groupBy("__b").agg(F.min_by("source_key", F.xxhash64(F.lit(seed), "source_key")).alias("source_key"))
    fallback = good.agg(F.min("source_key").alias("__any"))
    failed = rows.where(~F.col(ok)).withColumn("__b", below(buckets, seed, "replace", key))
    out = failed.join(picked, "__b", "left").crossJoin(F.broadcast(fallback)).withColumn("source_key", F.coalesce("source_key", "__any")).drop("__b", "__any")
    return rows.where(ok).withColumn("source_key", F.col(key)).unionByName(out)


def few_shot(rows: DataFrame, pool: DataFrame, key: str, text: str, k: int, seed: int) -> DataFrame:
    """Rows with ``examples``: k texts of the pool, in hash order, the same for all rows (the pool's least hashes)."""
    chosen = pool.orderBy(uniform(seed, "few-shot", text), text).limit(k).agg(F.array_sort(F.collect_list(text)).alias("examples"))
    return rows.crossJoin(F.broadcast(chosen))


# --- order, keys and integrity -----------------------------------------------------------


def restored(rows: DataFrame, order: DataFrame, key: str, position: str, partitions: int) -> DataFrame:
    """Rows in the order of a position table, ranged over partitions: what a writer needs to keep source order."""
    return rows.join(order, key).repartitionByRange(partitions, position).sortWithinPartitions(position)


def kv_key(path: Column, index: Column) -> Column:
    """``parent/stem_index`` of a file's path and a record's number."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.concat(F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -2), F.lit("/"))).otherwise(""), stem, F.lit("_"), index.cast("string"))


def kv_records(rows: DataFrame, path: str, index: str) -> DataFrame:
    """``(key, value)``: each row as JSON under its unique key."""
    return rows.select(kv_key(F.col(path), F.col(index)).alias("key"), F.to_json(F.struct(*(c for c in rows.columns if c not in (path, index)))).alias("value"))


def kv_integrity(keys: DataFrame, kv: DataFrame, schema: str, *by: str) -> DataFrame:
    """By group: keys expected, stored, missing, unexpected and not readable as ``schema``; ``ok`` if all is well."""
    joined = keys.withColumn("__k", F.lit(1)).join(kv.withColumn("__v", F.lit(1)), ["key", *by], "full")
    broken = F.col("__v").isNotNull() & F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})["_corrupt_record"].isNotNull()
    out = joined.groupBy(*by).agg(
        F.count("__k").alias("expected"), F.count("__v").alias("stored"), F.sum(F.when(F.col("__v").isNull(), 1).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("__k").isNull(), 1).otherwise(0)).alias("unexpected"), F.sum(F.when(broken, 1).otherwise(0)).alias("broken"),
    )
    return out.withColumn("ok", F.expr("missing = 0 AND unexpected = 0 AND broken = 0"))


def sha_matches(data: Column, expected: Column) -> Column:
    """Whether the first 32 digits of sha256 are as expected."""
    return F.substring(F.sha2(data, 256), 1, 32) == expected


def local_name(path: Column) -> Column:
    """A download's own file name: the base name and the md5 of the whole path."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("_"), F.md5(path))


def index_meta(name: Column) -> Column:
    """struct(id, count, h, w) of ``id_count_h-w_other.index`` (a ``good`` first part shifts the rest); null where it doesn't fit."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(base, "_")
    parts = F.when(F.get(parts, 0) == "good", F.slice(parts, 2, 1000)).otherwise(parts)
    size = F.split(F.get(parts, 2), "-")
    n = lambda c: c.try_cast("int")
    return F.struct(F.get(parts, 0).alias("id"), n(F.get(parts, 1)).alias("count"), n(F.get(size, 0)).alias("h"), n(F.get(size, 1)).alias("w"))


def rewritten_path(path: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """The first rule whose mark is in a path replaces one part of it."""
    out = path
    for mark, (old, new) in reversed(rules.items()):
        out = F.when(path.contains(mark), F.replace(path, F.lit(old), F.lit(new))).otherwise(out)
    return out


# --- projections -------------------------------------------------------------------------


def patched_text(text: Column, key: str, caption: Column) -> Column:
    """JSON captions with one more entry; no text counts as an empty map."""
    return F.to_json(F.map_concat(F.map_filter(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(F.lit(key), caption)))


def text_or_title(text: Column, meta: Column) -> Column:
    """A map of captions: the text, else the title in the metadata, else an empty caption."""
    title = F.get_json_object(meta, "$.title")
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map(F.lit("text"), F.coalesce(title, F.lit(""))))


def with_source_suffix(text: Column, source: Column, names: dict[str, str], p: float, u: Column) -> Column:
    """`` SEP name`` after a caption with probability ``p``; unknown sources keep their own name."""
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), source), source) if names else source
    return F.when((u < p) & source.isNotNull(), F.concat(text, F.lit(" SEP "), name)).otherwise(text)


def as_captions(cap: Column) -> Column:
    """An array of a caption that is a text or a JSON list of texts."""
    return F.when(cap.startswith("["), F.coalesce(F.from_json(cap, "array<string>"), F.array(cap))).otherwise(F.array(cap))


def image_paths(text: Column) -> Column:
    """Paths in ``<img='...'>`` marks."""
    return F.regexp_extract_all(text, F.lit("<img='(.*?)'>"), F.lit(1))


def image_slots(*slots: Column) -> Column:
    return F.array_compact(F.array(*slots))


def parent_and_name(path: Column) -> Column:
    """``folder/first segment/path`` with the first segment doubled, as extracted archives have it."""
    return F.concat(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("/"), path)


def middle_category(identifier: Column) -> Column:
    """The parts of an id between its first and its last."""
    parts = F.split(identifier, "_")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


# --- buckets ------------------------------------------------------------------------------


def bucket_table(ratios: DataFrame, ratio_map: str) -> DataFrame:
    """``(name, ratio, h, w, frames)`` of a map of ratio names to sizes: a row for each."""
    return ratios.select("*", F.explode(ratio_map).alias("ratio", "size")).withColumns({"h": F.get("size", 0), "w": F.get("size", 1), "frames": F.lit(49)}).drop("size", ratio_map)


def full_batches(rows: DataFrame, bucket: str, order: list[str], size: Column | int) -> DataFrame:
    """Rows of full batches with ``batch`` and ``place``; a bucket's rest is left out."""
    b = F.lit(size) if isinstance(size, int) else size
    w = Window.partitionBy(bucket)
    placed = rows.withColumn("__rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    return placed.withColumn("batch", F.floor(F.col("__rn") / b)).withColumn("place", F.col("__rn") % b).where(F.col("batch") < F.floor(F.col("__n") / b)).drop("__rn", "__n")


def collated(rows: DataFrame, key: list[str], order: str, *columns: str) -> DataFrame:
    """A row for each key with a list for each column, in order."""
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("__l"))
    return listed.select(*key, *(F.col(f"__l.{c}").alias(c) for c in columns))


def histogram(rows: DataFrame, *bucket: str, count: str) -> DataFrame:
    return rows.groupBy(*bucket).agg(F.sum(count).alias("count"))


def kept_totals(before: DataFrame, after: DataFrame, file: str) -> DataFrame:
    """``(file, total, kept)`` of a cleaning job, files of which nothing is left included."""
    kept = after.groupBy(file).agg(F.count("*").alias("kept"))
    return before.groupBy(file).agg(F.count("*").alias("total")).join(kept, file, "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("bigint")))


def latest_numbered(names: DataFrame, name: str) -> DataFrame:
    """The name that is the largest number, such as a run's last checkpoint; other names are ignored."""
    return names.where(F.col(name).rlike(r"^\d+$")).agg(F.max_by(name, F.col(name).cast("bigint")).alias(name))


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in rest))
