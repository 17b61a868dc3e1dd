"""Reading records: JSON, JSON lines, tar archives, Parquet by row group, tables, key-value files, folders of images.

Bad records are skipped, not fatal: JSON is read permissively and rows that did not
parse stand apart in ``bad_records``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spindle.durable import stored
from spindle.functions.det import digest
from spindle.operators.records import small
from spindle.ship import ship

# Record schemas.
VIDEO = "cut array<int>, crop array<int>, tech double, motion double, fps double, num_frames int, resolution struct<height:int,width:int>, cap array<string>, path string, aesthetic double"
TEXT_IMAGE = "path string, cap string"
CHAT = "image string, video string, conversations array<struct<`from`:string,value:string>>"
CORRUPT = "_corrupt_record"


def json_files(spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = True) -> DataFrame:
    """Rows of JSON files (arrays, or a record a line); rows that don't parse have only ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(paths)


def good_records(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(df: DataFrame) -> DataFrame:
    other = next(c for c in df.columns if c != CORRUPT)  # Spark refuses to read the corrupt column alone
    return df.where(F.col(CORRUPT).isNotNull() & F.coalesce(F.col(f"`{other}`").cast("string"), CORRUPT).isNotNull()).select(CORRUPT)


def with_folders(spark: SparkSession, pairs: Iterable[tuple[str, str]], schema: str) -> DataFrame:
    """Records of (JSON path, image folder) pairs, each with its folder."""
    return reduce(DataFrame.unionByName, [good_records(json_files(spark, p, schema)).withColumn("image_dir", F.lit(d)) for p, d in pairs])


def json_listing(spark: SparkSession, folder: str, without: str = "key.json") -> DataFrame:
    """``(path, length)`` of a folder's JSON files but those whose name ends in ``without``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "length")
    return files.where(~F.col("path").endswith(without))


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, length, modificationTime)`` of files under a folder by name pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).drop("content")


def whole_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")


def cached_listing(spark: SparkSession, folder: str, pattern: str, cache: str) -> DataFrame:
    """A folder's listing, written once as Parquet and read from there after."""
    listing(spark, folder, pattern).write.mode("ignore").parquet(cache)
    return spark.read.parquet(cache)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of a text file, read as one split so that numbers follow the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "value"))


def first_lines(rows: DataFrame, file: str, order: list[Column | str], n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` lines of each file, in order or (with a seed) in hash order."""
    from pyspark.sql import Window

    keys = [digest(seed, "lines", file, *order)] if seed is not None else []
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(file).orderBy(*keys, *order))).where(F.col("__rn") <= n).drop("__rn")


def keyed_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``(key, ...)`` of a JSON file that is one object of records."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("key", "r")).select("key", "r.*")


def separated(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """Rows of a CSV or TSV file; quoted fields may span lines."""
    reader = spark.read.option("sep", sep).option("header", header).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def subjects(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Parquet tables of several subjects as one, with ``subject``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{root}/{n}").withColumn("subject", F.lit(n)) for n in names])


# --- Parquet -----------------------------------------------------------------------------


def row_positions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Rows with their file and their number in it."""
    return spark.read.parquet(path).select(*(columns or ["*"]), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def source_positions(placed: DataFrame, position: str = "position") -> DataFrame:
    """Rows of ``row_positions`` with their number over all files that Spark wrote in order: by task, then by a task's files.

    Both numbers of a file's name are compared as numbers, as they get longer beyond 99,999 tasks and 999 files.
    """
    name = F.element_at(F.split("file", "/"), -1)
    number = lambda k: F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)\.", k).cast("long")
    files = placed.groupBy("file").agg(F.count("*").alias("__n")).select("file", "__n", number(1).alias("__task"), number(2).alias("__of"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = files.groupBy("__task").agg(F.sum("__n").alias("__n")).select("__task", before(Window.orderBy("__task")).alias("__first"))
    within = files.withColumn("__in", before(Window.partitionBy("__task").orderBy("__of")))
    starts = within.join(tasks, "__task").select("file", (F.col("__first") + F.col("__in")).alias("__start"))
    starts = stored(starts, "starts", 0)  # a row for each file, counted and joined: files are read once for it
    return placed.join(small(starts), "file").withColumn(position, F.col("__start") + F.col("row_index")).drop("__start")


_GROUPS = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64())])


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import struct

    import pyarrow.parquet as pq

    for b in batches:
        out = []
        for path, tail in zip(b.column("path").to_pylist(), b.column("tail").to_pylist(), strict=True):
            size = struct.unpack("<I", tail[-8:-4])[0]
            # a footer alone, behind the magic that opens a file, is a file without data
            meta = pq.ParquetFile(io.BytesIO(b"PAR1" + tail[-8 - size :])).metadata
            out.extend((path, i, meta.row_group(i).num_rows, meta.row_group(i).total_byte_size) for i in range(meta.num_row_groups))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _GROUPS.types, strict=True)] if out else [pa.array([], t) for t in _GROUPS.types], schema=_GROUPS)


def row_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, row_group, rows, bytes)`` of Parquet files, from their footers: the unit of work for row-group plans.

    Python gets the footers alone, cut from the files by Spark; a file that is none is an error.
    """
    ship(spark)
    files = whole_files(spark, folder, "*.parquet")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 1)), 16, 10).cast("int")
    length = number(-8) + number(-7) * 256 + number(-6) * 65536 + number(-5) * 16777216
    return files.select("path", F.substring("content", -(length + 8), length + 8).alias("tail")).mapInArrow(_footers, "path string, row_group int, rows long, bytes long")


def exact_count(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows, from footers alone."""
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


def approximate_count(files: DataFrame, order: str, rows: str, sample: int = 5) -> DataFrame:
    """Mean rows of the first files times the number of files."""
    first = files.orderBy(order).limit(sample).agg(F.avg(rows).alias("mean"))
    return files.agg(F.count("*").alias("files")).crossJoin(first).select(F.floor(F.col("mean") * F.col("files")).alias("rows"))


def metadata_of(files: DataFrame, meta: DataFrame, path: str) -> DataFrame:
    """Row groups of listed files by side metadata; files without metadata are left out (see ``without_metadata``)."""
    return files.join(meta, path).withColumn("row_group", F.explode(F.sequence(F.lit(0), F.col("num_row_groups") - 1)))


def without_metadata(files: DataFrame, meta: DataFrame, path: str) -> DataFrame:
    return files.join(meta, path, "left_anti")


# --- archives ------------------------------------------------------------------------------

_MEMBERS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("stem", pa.string()), ("ext", pa.string()), ("content", pa.binary())])


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import tarfile

    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            out = []
            try:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            folder, _, base = m.name.rpartition("/")
                            stem, _, ext = base.partition(".")
                            out.append((path, m.name, f"{folder}/{stem}" if folder else stem, ext, tar.extractfile(m).read()))
            except (tarfile.TarError, OSError, EOFError):
                out.append((path, None, None, None, None))  # a broken archive is one row without a member
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _MEMBERS.types, strict=True)], schema=_MEMBERS)


def tar_members(spark: SparkSession, folder: str, pattern: str = "*.tar") -> DataFrame:
    """``(archive, member, stem, ext, content)`` of all files of all archives; a broken archive ends with a row of nulls."""
    ship(spark)
    return whole_files(spark, folder, pattern).mapInArrow(_expanded, "archive string, member string, stem string, ext string, content binary")


def tar_pairs(members: DataFrame, image: str = "jpg", text: str = "txt") -> DataFrame:
    """``(archive, stem, image, text)`` of members that share a stem and have both."""
    pick = lambda e: F.max(F.when(F.col("ext") == e, F.col("content")))
    return members.where("member IS NOT NULL").groupBy("archive", "stem").agg(pick(image).alias("image"), F.decode(pick(text), "UTF-8").alias("text")).where("image IS NOT NULL AND text IS NOT NULL")


def tar_report(members: DataFrame) -> DataFrame:
    """One row: archives, those that could be read, and members."""
    per = members.groupBy("archive").agg(F.count("member").alias("n"), F.count(F.when(F.col("member").isNull(), 1)).alias("broken"))
    return per.agg(F.count("*").alias("archives"), F.sum((F.col("broken") == 0).cast("int")).alias("good"), F.sum("n").alias("members"))


def _unpickled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import json
    import pickle

    class Plain(pickle.Unpickler):
        def find_class(self, module, name):
            raise pickle.UnpicklingError(f"{module}.{name} is not plain data")

    schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("record", pa.string())])
    for b in batches:
        out = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                records = json.loads(content) if path.endswith(".json") else Plain(io.BytesIO(content)).load()
                out.extend((path, i, json.dumps(r, sort_keys=True)) for i, r in enumerate(records))
            except (ValueError, pickle.UnpicklingError, EOFError, TypeError):
                continue
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, idx, record)`` of JSON and pickle files of plain records, each as JSON; files that can't be read give no row."""
    ship(spark)
    return whole_files(spark, folder).where(F.col("path").rlike(r"\.(json|pkl|pickle)$")).mapInArrow(_unpickled, "path string, idx long, record string")


def decoded_value(value: Column, schema: str) -> Column:
    """A key-value record: JSON text, as text or as bytes; null if it is none."""
    return F.from_json(value.cast("string"), schema)


def bson_to_plain(data: bytes) -> dict:
    """A BSON document as plain values: numbers, texts, truth values, nulls, lists, documents; bytes as base64 text."""
    import base64
    import struct

    def text(at: int) -> tuple[str, int]:
        end = data.index(b"\0", at)
        return data[at:end].decode(), end + 1

    def document(at: int, listed: bool):
        end = at + struct.unpack_from("<i", data, at)[0] - 1
        at += 4
        out: dict = {}
        while at < end:
            kind = data[at]
            name, at = text(at + 1)
            if kind in (0x03, 0x04):
                out[name], at = document(at, kind == 0x04)
            elif kind in (0x02, 0x05):
                size = struct.unpack_from("<i", data, at)[0]
                start = at + 4 + (kind == 0x05)
                raw = data[start : start + size]
                out[name], at = (raw[:-1].decode() if kind == 0x02 else base64.b64encode(raw).decode()), start + size
            elif kind in (0x01, 0x10, 0x12):
                form = {0x01: "<d", 0x10: "<i", 0x12: "<q"}[kind]
                out[name], at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
            elif kind == 0x08:
                out[name], at = data[at] == 1, at + 1
            elif kind == 0x0A:
                out[name] = None
            else:
                raise ValueError(f"BSON type {kind:#x} is not plain")
        return (list(out.values()) if listed else out), end + 1

    return document(0, False)[0]


def decoded_records(df: DataFrame, value: str, out: str = "record") -> DataFrame:
    """``df`` with each key-value record as JSON text, from JSON or BSON bytes; null if it is neither."""
    ship(df.sparkSession)
    return df.mapInArrow(_decoder(value, out), StructType([*df.schema.fields, StructField(out, StringType())]))


def _decoder(value: str, out: str):
    def plain(data: bytes | None) -> str | None:
        import json
        import struct

        if data is None:
            return None
        for read in (lambda d: json.loads(d), bson_to_plain):
            try:
                return json.dumps(read(data), sort_keys=True)
            except (ValueError, struct.error, IndexError):
                continue
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = pa.array([plain(v) for v in b.column(value).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, records], names=[*b.schema.names, out])

    return run


def float_tensor(data: Column, shape: Column) -> Column:
    """struct(size, ok) of raw 32-bit floats against a shape."""
    n = F.aggregate(shape, F.lit(1), lambda s, x: s * x)
    return F.struct((F.length(data) / 4).cast("int").alias("size"), (F.length(data) == 4 * n).alias("ok"))
