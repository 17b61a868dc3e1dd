"""Sources and sinks by round trips through the shared folder; projections, strict joins, inference packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.durable import table_path
from spindle.functions import frames, tokens
from spindle.operators import records
from spindle.plans import spans
from spindle.queries.registry import Tables, query
from spindle.sources import readers, sinks
from spindle.streaming import carry, resume


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "json")
    sinks.json_records(Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return readers.good_records(readers.json_files(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", multi_line=False))


@query("SELECT n_nationkey, n_name, CAST(2 AS BIGINT) AS appended, CAST(1 AS BIGINT) AS once FROM nation")
def q_json_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending twice gives every row twice, writing once more nothing."""
    rows, schema = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name"), "n_nationkey long, n_name string"
    a, b = table_path(spark, "appended"), table_path(spark, "once")
    for _ in range(2):
        sinks.json_append(rows, a)
        sinks.json_once(rows, b)
    counted = lambda p, n: readers.good_records(readers.json_files(spark, p, schema, multi_line=False)).groupBy("n_nationkey", "n_name").agg(F.count("*").alias(n))
    return counted(a, "appended").join(counted(b, "once"), ["n_nationkey", "n_name"])


@query("SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS bad FROM documents WHERE doc_id % 7 <> 0")
def q_broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record is cut short: it stands apart, the others are read."""
    path = table_path(spark, "broken")
    record = F.to_json(F.struct("doc_id", "lang"))
    Tables(spark, sf_dir).documents.select(F.when(F.col("doc_id") % 7 == 0, F.substring(record, 1, 5)).otherwise(record).alias("value")).write.text(path)
    found = readers.json_files(spark, path, "doc_id long, lang string", multi_line=False)
    return readers.good_records(found).crossJoin(F.broadcast(readers.bad_records(found).agg(F.count("*").alias("bad")))).select("doc_id", "lang", "bad")


@query("SELECT 'f/part' || CAST(doc_id % 9 AS VARCHAR) || '_' || CAST(doc_id AS VARCHAR) AS key, lang, source FROM documents")
def q_key_value_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "kv")
    rows = Tables(spark, sf_dir).documents.select(F.concat(F.lit("a/f/part"), (F.col("doc_id") % 9).cast("string"), F.lit(".json")).alias("path"), "doc_id", "lang", "source")
    sinks.key_values(rows, path, "path", "doc_id")
    kv = spark.read.parquet(f"{path}/keys").join(spark.read.parquet(f"{path}/kv"), "key")
    return kv.select("key", readers.decoded_value(F.col("value"), "lang string, source string").alias("r")).select("key", "r.*")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def q_separated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "separated")
    sinks.separated(Tables(spark, sf_dir).customer, path, "\t", ("c_nationkey",))
    return readers.separated(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", "\t")


@query("SELECT o_orderkey, o_orderstatus AS subject FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def q_subject_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "subjects")
    orders = Tables(spark, sf_dir).orders
    for name in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == name).select("o_orderkey").write.parquet(f"{path}/{name}")
    return readers.subjects(spark, path, ["F", "O", "P"]).select("o_orderkey", "subject")


@query("SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS number, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def q_keyed_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "object")
    record = F.struct("n_name", F.struct(F.col("n_nationkey").alias("number"), F.col("n_regionkey").alias("region")))
    Tables(spark, sf_dir).nation.agg(F.to_json(F.map_from_entries(F.collect_list(record))).alias("value")).write.text(path)
    return readers.keyed_object(spark, path, "number bigint, region bigint")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, p_name || ' / ' || p_brand AS value FROM part")
def q_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "report")
    sinks.text_report(Tables(spark, sf_dir).part.orderBy("p_partkey"), path, F.concat_ws(" / ", "p_name", "p_brand"))
    return readers.lines(spark, path).select(F.col("line_no").cast("long").alias("line_no"), "value")


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer")
def q_source_order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the source's order: a row's number follows from its file's name and its place in it."""
    from spindle.operators.shard import numbered

    path = table_path(spark, "ordered")
    rows = Tables(spark, sf_dir).customer
    order = numbered(rows, "c_acctbal", "c_custkey").select("c_custkey", "position")
    sinks.in_source_order(rows, order, "c_custkey", "position", path, 3, 100)
    return readers.source_positions(readers.row_positions(spark, path, "c_custkey", "c_name")).select("c_custkey", "c_name", "position")


@query("SELECT event_type AS dataset, user_id AS shard, CAST(count(*) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS seen FROM events GROUP BY 1, 2")
def q_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset's state is replaced, the others' stays."""
    path = table_path(spark, "state")
    state = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("shard")).agg(F.count("*").alias("seen"))
    sinks.state_table(state, path, "dataset")
    sinks.state_table(state.where("dataset = 'click'").withColumn("seen", F.col("seen") + 1), path, "dataset")
    return spark.read.parquet(path).select("dataset", "shard", "seen")


@query("SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS seen FROM events GROUP BY 1, 2")
def q_restored_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "visits")
    events = Tables(spark, sf_dir).events.select("event_type", "user_id")
    events.limit(0).withColumn("seen", F.lit(1).cast("long")).write.parquet(path)
    resume.restored_visits(events.groupBy("event_type", "user_id").agg(F.count("*").alias("seen")), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey FROM orders")
def q_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a folder's files, run twice on one checkpoint: each row comes once."""
    source, out, checkpoint = (table_path(spark, n) for n in ("incoming", "streamed", "checkpoint"))
    rows = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey")
    for half in (0, 1):
        rows.where(F.col("o_orderkey") % 2 == half).write.mode("append").parquet(source)
        resume.run_available(resume.file_stream(spark, source, "o_orderkey long, o_custkey long"), out, checkpoint)
    return spark.read.parquet(out)


_STREAMED = """
WITH RECURSIVE t AS (SELECT event_type AS shard, event_id AS id, user_id % 50 + 1 AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE event_id < 2000),
p AS (
  SELECT shard, rn, id, n, n AS fill, CAST(0 AS BIGINT) AS bin FROM t WHERE rn = 1
  UNION ALL
  SELECT t.shard, t.rn, t.id, t.n, CASE WHEN p.fill >= 100 OR p.fill + t.n > 120 THEN t.n ELSE p.fill + t.n END, CASE WHEN p.fill >= 100 OR p.fill + t.n > 120 THEN p.bin + 1 ELSE p.bin END
  FROM p JOIN t ON t.shard = p.shard AND t.rn = p.rn + 1
), b AS (SELECT shard, bin, max(fill) AS fill FROM p GROUP BY shard, bin), l AS (SELECT shard, max(bin) AS last FROM b GROUP BY shard)
SELECT shard, bin, CAST(count(*) AS BIGINT) AS samples, CAST(sum(n) AS BIGINT) AS tokens FROM p JOIN b USING (shard, bin) JOIN l USING (shard) WHERE bin < last OR b.fill >= 100 GROUP BY shard, bin
"""


@query(_STREAMED)
def q_packed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of each type, packed in event order as they come; the open sequence is not out yet."""
    source, out, checkpoint = (table_path(spark, n) for n in ("samples", "sequences", "checkpoint"))
    rows = Tables(spark, sf_dir).events.where("event_id < 2000").select(F.col("event_type").alias("shard"), F.col("event_id").alias("id"), (F.col("user_id") % 50 + 1).alias("n"))
    for first in (0, 1000):
        rows.where((F.col("id") >= first) & (F.col("id") < first + 1000)).coalesce(1).sortWithinPartitions("id").write.mode("append").parquet(source)
        stream = resume.file_stream(spark, source, "shard string, id long, n long")
        resume.run_available(stream, out, checkpoint, lambda s: carry.packed_stream(s, 100, 120))
    return spark.read.parquet(out).groupBy("shard", "bin").agg(F.count("*").alias("samples"), F.sum("n").alias("tokens"))


@query("SELECT p_partkey, CAST(p_size * 3 AS BIGINT) AS w, CAST(p_size + 5 AS BIGINT) AS h, 'png' AS kind FROM part")
def q_image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    data = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("p_size") * 3), number(F.col("p_size") + 5), F.lit("08020000")))
    p = Tables(spark, sf_dir).part.select("p_partkey", records.image_size(data).alias("s"), records.image_kind(data).alias("kind"))
    return p.select("p_partkey", F.col("s.w").cast("long").alias("w"), F.col("s.h").cast("long").alias("h"), "kind")


@query("SELECT c_custkey, 'a/' || c_name || '.jpg|' || c_mktsegment || '.png' AS paths FROM customer")
def q_image_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("See <img='a/"), "c_name", F.lit(".jpg'> and <img='"), "c_mktsegment", F.lit(".png'>."))
    return Tables(spark, sf_dir).customer.select("c_custkey", F.array_join(records.image_paths(text), "|").alias("paths"))


@query("SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN '|' || source ELSE '' END AS captions FROM documents")
def q_caption_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(F.col("lang"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.array_join(records.as_captions(cap), "|").alias("captions"))


@query("SELECT doc_id, source AS caption, CASE WHEN doc_id % 3 > 0 THEN lang END AS old FROM documents")
def q_patched_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 > 0, F.to_json(F.struct(F.col("lang").alias("old"), F.lit("gone").alias("new"))))
    p = Tables(spark, sf_dir).documents.select("doc_id", records.patched_text(text, "new", F.col("source")).alias("t"))
    return p.select("doc_id", F.get_json_object("t", "$.new").alias("caption"), F.get_json_object("t", "$.old").alias("old"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 's' || CAST(s_suppkey AS VARCHAR) || '/' ELSE s_name || '/' END || CASE WHEN s_suppkey % 3 = 0 THEN 's' || CAST(s_suppkey AS VARCHAR) ELSE s_name END || '/x.jpg' AS path FROM supplier")
def q_archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name")), F.lit("/x.jpg"))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", records.parent_and_name(path).alias("path"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS first_group FROM orders")
def q_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the footers of a table written in three files."""
    path = table_path(spark, "groups")
    Tables(spark, sf_dir).orders.repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    return readers.row_groups(spark, path).agg(F.sum("rows").alias("rows"), F.min("row_group").cast("long").alias("first_group"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    gold = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return records.with_gold(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), gold, ["l_orderkey"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_with_gold_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    gold = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return records.with_gold(t.nation, gold, ["n_regionkey"], strict=True).select("n_nationkey", "n_name", "r_name")


@query("""WITH s AS (SELECT p_brand, p_size % 7 AS l, p_size % 3 + 1 AS b, sum(p_size % 7 + p_size % 3 + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey) - (p_size % 7 + p_size % 3 + 1) AS s FROM part)
SELECT p_brand, CAST(sum(b) AS BIGINT) AS new, CAST(sum(b * (s + l) + b * (b - 1) // 2) AS BIGINT) AS query_places, CAST(sum(l) AS BIGINT) AS cached, CAST(sum(l * s + l * (l - 1) // 2) AS BIGINT) AS cached_places FROM s GROUP BY p_brand""")
def q_inference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of new and of cached tokens of sequences that follow each other, here the parts of a brand."""
    rows = Tables(spark, sf_dir).part.select("p_brand", "p_partkey", (F.col("p_size") % 7).cast("bigint").alias("l"), (F.col("p_size") % 3 + 1).cast("bigint").alias("b"))
    i = spans.inference_places(rows, ["p_brand"], "p_partkey", "l", "b")
    n = lambda c: F.sum(F.size(c).cast("long"))
    add = lambda c: F.sum(F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda s, x: s + x))
    return i.groupBy("p_brand").agg(n("query").alias("new"), add("query").alias("query_places"), n("cached").alias("cached"), add("cached").alias("cached_places"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS frames, CAST(p_size * (p_size - 1) // 2 AS BIGINT) AS total, CAST(CASE WHEN greatest(0, p_size - 9) <= 3 THEN least(3, greatest(0, p_size - 9)) ELSE 3 + floor(0.5 * (greatest(0, p_size - 9) - 2)) END AS BIGINT) AS start FROM part")
def q_all_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.all_frames(F.col("p_size"))
    total = F.aggregate(f, F.lit(0), lambda s, x: s + x)
    return Tables(spark, sf_dir).part.select("p_partkey", F.size(f).cast("long").alias("frames"), total.cast("long").alias("total"), frames.window_start(F.lit(3), F.col("p_size"), 8, F.lit(0.5)).cast("long").alias("start"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'short|long' ELSE 'short' END AS keys FROM documents")
def q_caption_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.map_filter(F.create_map(F.lit("long"), F.when(F.col("lang") == "en", F.col("source")), F.lit("other"), F.col("lang"), F.lit("short"), F.col("source")), lambda _, v: v.isNotNull())
    return Tables(spark, sf_dir).documents.select("doc_id", F.array_join(frames.all_keys(texts, ["short", "none", "long"]), "|").alias("keys"))


@query("SELECT l_orderkey, CAST(sum(CASE WHEN l_partkey % 50 IN (3, 7) THEN 1 ELSE 0 END) AS BIGINT) AS special, CAST(count(*) + CASE WHEN arg_max(l_partkey % 50, (l_linenumber, l_partkey % 50)) = 7 THEN 0 ELSE 1 END AS BIGINT) AS ended FROM lineitem GROUP BY l_orderkey")
def q_special_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).cast("int").alias("id"))
    ids = records.collated(rows, ["l_orderkey"], "l_linenumber", "id")
    mask = F.aggregate(tokens.special_mask(F.col("id"), [3, 7]), F.lit(0), lambda s, x: s + x)
    return ids.select("l_orderkey", mask.cast("long").alias("special"), F.size(tokens.with_eos(F.col("id"), 7)).cast("long").alias("ended"))
