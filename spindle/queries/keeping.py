"""Filters, joins, sources, integrity, order and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import frames
from spindle.functions.det import sql_uniform, uniform
from spindle.operators import records
from spindle.operators.shard import numbered
from spindle.queries.registry import Tables, query
from spindle.sources import readers, sinks
from spindle.streaming import resume


@query("SELECT doc_id, source, CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id)")
def q_caption_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "source", F.lit(None).cast("int").alias("quality"))
    return records.caption_override(rows, t.labels, "doc_id", "quality").select("doc_id", "source", F.col("quality").cast("long").alias("quality"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE lang END AS lang, source FROM documents JOIN labels USING (doc_id)")
def q_uttid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    other = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return records.aligned(t.documents.select("doc_id", "lang", "source"), other, key="doc_id").select("doc_id", "lang", "source")


@query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def q_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.repeated_keys(Tables(spark, sf_dir).lineitem, "l_partkey")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY user_id, event_id) - 1 AS position FROM events")
def q_restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", "event_type")
    order = numbered(e, "user_id", "event_id").select("event_id", "position")
    return records.restored(e, order, "event_id", "position", 4).select("event_id", "event_type", "position")


@query("SELECT doc_id, substr(sha256(text), 1, 32) = substr(sha256(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE text END), 1, 32) AS ok FROM documents")
def q_sha_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.substring(F.sha2(F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("text")), 256), 1, 32)
    return Tables(spark, sf_dir).documents.select("doc_id", records.sha_matches(F.col("text").cast("binary"), expected).alias("ok"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'd0' ELSE 'd1' END AS folder FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def q_exists_any_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders.select("o_orderkey")
    folder = lambda n, m: o.where(F.col("o_orderkey") % m == 0).select("o_orderkey", F.lit(f"d{n}").alias("folder"), F.lit(n).alias("at"))
    return records.first_existing(o, folder(0, 2).union(folder(1, 3)), "o_orderkey", "folder", "at")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return records.unprocessed(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS expected, CAST(sum(CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS stored, CAST(sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  CAST(sum(CASE WHEN event_id % 50 <> 0 AND event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM events GROUP BY event_type""")
def q_kv_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.withColumn("key", F.concat(F.lit("f/part_"), F.col("event_id").cast("string")))
    kv = e.where("event_id % 50 <> 0").select("key", "event_type", F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props")).alias("value"))
    return records.kv_integrity(e.select("key", "event_type"), kv, "k string", "event_type").select("event_type", "expected", "stored", "missing", "broken")


@query("""WITH r AS (SELECT event_id, user_id, value > 60 AS bad, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS run FROM r""")
def q_reject_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", (F.col("value") > 60).alias("bad"))
    return records.reject_runs(e, "user_id", ["event_id"], "bad").select("event_id", "run")


@query("""WITH r AS (SELECT event_id, user_id, value > 60 AS bad, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
n AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS run FROM r), b AS (SELECT *, max(CASE WHEN run > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS broken FROM n)
SELECT event_id FROM b WHERE broken = 0 AND NOT bad""")
def q_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", (F.col("value") > 60).alias("bad"))
    return records.until_breaker(e, "user_id", ["event_id"], "bad", 3).select("event_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR quality >= 1) AND n_chars >= 256 AND doc_id >= 16 AND lang <> 'none'")
def q_aesthetic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.documents.drop("text").join(t.labels, "doc_id", "left")
    keep = records.all_of(records.aesthetic_at_least(F.col("quality"), 1), records.covers_bucket(F.col("n_chars"), F.col("doc_id"), F.lit(256), F.lit(16)), records.has_text(F.col("lang")))
    return rows.where(keep).select("doc_id")


@query("""WITH s AS (SELECT vec_id, list_avg(embedding) AS mean, list_stddev_pop(embedding) AS std FROM embeddings)
SELECT vec_id, round(mean, 5) AS mean, round(std, 5) AS std, NOT (std < 0.02 AND mean < -0.9) AS kept FROM s""")
def q_black_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).embeddings.select("vec_id", records.pixel_stats(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    return s.select("vec_id", F.round("s.mean", 5).alias("mean"), F.round("s.std", 5).alias("std"), records.not_black(F.col("s.std"), F.col("s.mean")).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE CAST(l_partkey AS DOUBLE) / (l_suppkey * 20 + 1) BETWEEN 0.7 AND 1.5")
def q_ratio_sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = records.ratio_sane(F.col("l_partkey").cast("double"), F.col("l_suppkey") * 20 + 1)
    return Tables(spark, sf_dir).lineitem.where(keep).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p >= n // 2")
def q_from_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(Tables(spark, sf_dir).documents, "doc_id").where(F.col("position") >= F.floor(F.col("n") * 0.5)).select("doc_id")


@query("SELECT event_type AS dataset, CAST(s.shard AS BIGINT) AS shard, CAST(count(e.event_id) AS BIGINT) AS seen FROM (SELECT DISTINCT event_type FROM events) d CROSS JOIN (SELECT unnest(range(0, 160)) AS shard) s LEFT JOIN events e USING (event_type) WHERE e.user_id = s.shard GROUP BY 1, 2 "
       "UNION ALL SELECT d.event_type, s.shard, 0 FROM (SELECT DISTINCT event_type FROM events) d CROSS JOIN (SELECT unnest(range(0, 160)) AS shard) s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = d.event_type AND e.user_id = s.shard)")
def q_visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Tables(spark, sf_dir).events.select(F.col("event_type").alias("dataset"), F.col("user_id").cast("int").alias("shard"))
    return resume.visit_counts(log, "dataset", "shard", 160).select("dataset", F.col("shard").cast("long").alias("shard"), "seen")


@query("""WITH v AS (SELECT event_type AS dataset, user_id AS shard, count(*) AS seen FROM events GROUP BY 1, 2), m AS (SELECT *, max(seen) OVER (PARTITION BY dataset) AS most FROM v)
SELECT dataset, CAST(shard AS BIGINT) AS shard, CAST(unnest(range(1, most - seen + 1)) AS BIGINT) AS replica FROM m WHERE seen < most""")
def q_remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("dataset"), F.col("user_id").alias("shard")).agg(F.count("*").alias("seen"))
    return resume.remaining_work(v, "dataset", "shard").select("dataset", "shard", "replica")


@query("SELECT event_type, user_id, max(event_id) AS position FROM events GROUP BY 1, 2")
def q_last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = Tables(spark, sf_dir).events.select("event_type", "user_id", "event_id", F.col("event_id").alias("position"))
    return resume.last_positions(log, "event_type", "user_id", position="position", order=["event_id"])


@query("SELECT e.event_id FROM events e WHERE e.user_id % 3 <> 0 OR e.event_id > 5000")
def q_resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("user_id", "event_id")
    state = e.select("user_id").distinct().where("user_id % 3 = 0").withColumn("event_id", F.lit(5000).cast("long"))
    return resume.remaining(e, state, ["user_id"], ["event_id"]).select("event_id")


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_of_each(Tables(spark, sf_dir).documents.select("source", "doc_id", "lang"), ["source"], "doc_id")


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS total, round(list_sum(list(l_quantity)), 4) AS quantity FROM lineitem GROUP BY l_orderkey")
def q_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = records.collated(Tables(spark, sf_dir).lineitem, ["l_orderkey"], "l_linenumber", "l_partkey", "l_quantity")
    add = lambda x, zero: F.aggregate(x, zero, lambda s, v: s + v)
    return c.select("l_orderkey", F.size("l_partkey").cast("long").alias("n"), add(F.col("l_partkey"), F.lit(0).cast("long")).alias("total"), F.round(add(F.col("l_quantity"), F.lit(0.0)), 4).alias("quantity"))


@query("SELECT 'f/' || CAST(doc_id % 9 AS VARCHAR) || '_' || CAST(doc_id AS VARCHAR) AS key, json_extract_string(json_object('lang', lang, 'source', source), '$.lang') AS lang FROM documents")
def q_kv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).documents.select(F.concat(F.lit("a/f/"), (F.col("doc_id") % 9).cast("string"), F.lit(".json")).alias("path"), "doc_id", "lang", "source")
    return records.kv_records(rows, "path", "doc_id").select("key", F.get_json_object("value", "$.lang").alias("lang"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS BIGINT) AS count, CAST(p_size * 8 AS BIGINT) AS h, CAST(64 AS BIGINT) AS w FROM part")
def q_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "x/good_").otherwise("x/"), F.col("p_partkey").cast("string"), F.lit("_"), size, F.lit("_"), (F.col("p_size") * 8).cast("string"), F.lit("-64_z.index"))
    m = Tables(spark, sf_dir).part.select("p_partkey", records.index_meta(name).alias("m"))
    return m.select("p_partkey", "m.id", *(F.col(f"m.{c}").cast("long").alias(c) for c in ("count", "h", "w")))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS BIGINT) AS frame, CASE WHEN p_size % 3 = 0 THEN 'b/' ELSE 'a/' END || p_brand AS path FROM part")
def q_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("v_"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ".jpg").otherwise(".png"))
    path = F.concat(F.when(F.col("p_size") % 3 == 0, "old/").otherwise("a/"), F.col("p_brand"))
    return Tables(spark, sf_dir).part.select("p_partkey", frames.frame_number(name).cast("long").alias("frame"), records.rewritten_path(path, {"old/": ("old/", "b/")}).alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'kept' WHEN event_id % 3 = 1 THEN event_type ELSE '' END AS caption FROM events")
def q_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events
    text = F.when(F.col("event_id") % 3 == 0, '{"text": "kept"}')
    meta = F.when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("title")))).otherwise("{}")
    return e.select("event_id", F.try_element_at(records.text_or_title(text, meta), F.lit("text")).alias("caption"))


@query(f"SELECT doc_id, lang || CASE WHEN {sql_uniform(1, 'suffix', 'doc_id')} < 0.3 THEN ' SEP ' || CASE WHEN source = 'src0' THEN 'first' ELSE source END ELSE '' END AS caption FROM documents")
def q_source_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = records.with_source_suffix(F.col("lang"), F.col("source"), {"src0": "first"}, 0.3, uniform(1, "suffix", "doc_id"))
    return Tables(spark, sf_dir).documents.select("doc_id", c.alias("caption"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM lineitem")
def q_exact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.exact_count(spark, f"{sf_dir}/lineitem.parquet")


@query("WITH f AS (SELECT source, count(*) AS n FROM documents GROUP BY source), s AS (SELECT avg(n) AS m FROM (SELECT n FROM f ORDER BY source LIMIT 5)) SELECT CAST(floor((SELECT m FROM s) * count(*)) AS BIGINT) AS rows FROM f")
def q_approximate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count("*").alias("n"))
    return readers.approximate_count(f, "source", "n")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 100")
def q_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_lines(Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 100)


@query("SELECT event_id, 'a_' || CAST(event_id % 4 AS VARCHAR) || '_b' AS category, md5('s/' || CAST(event_id AS VARCHAR)) AS digest FROM events")
def q_names_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.concat(F.lit("val_a_"), (F.col("event_id") % 4).cast("string"), F.lit("_b_"), F.col("event_id").cast("string"))
    local = records.local_name(F.concat(F.lit("s/"), F.col("event_id").cast("string")))
    return Tables(spark, sf_dir).events.select("event_id", records.middle_category(ident).alias("category"), F.split_part(local, F.lit("_"), F.lit(-1)).alias("digest"))


@query("SELECT doc_id, '{\"' || CAST(doc_id AS VARCHAR) || '.jpg\":\"' || source || '\"}' AS line FROM documents")
def q_named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", sinks.named_lines(F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"), F.lit(".jpg")), F.col("source")).alias("line"))


@query("SELECT l.c_custkey, l.c_name, r.s_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) l JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) r USING (p)")
def q_join_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return records.by_position(t.customer.select("c_custkey", "c_name"), t.supplier.select("s_suppkey", "s_name"), ["c_custkey"], ["s_suppkey"]).select("c_custkey", "c_name", "s_name")


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS gold FROM documents LEFT JOIN labels USING (doc_id)")
def q_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return records.with_default(t.documents.select("doc_id"), t.labels.select("doc_id", F.col("quality").cast("string").alias("gold")), "doc_id", "gold").select("doc_id", "gold")


@query("SELECT c_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def q_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    writes = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return records.last_write(t.customer.select("c_custkey"), writes, "c_custkey", "o_orderkey", "price").select("c_custkey", "price")


@query()
def q_replaced_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).documents.select("doc_id", (F.col("n_chars") >= 100).alias("ok"))
    return records.replaced_failures(rows, "doc_id", "ok", 5).select("doc_id", "ok", "source_key")


@query("SELECT w AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT date_trunc('day', ts) AS w, event_type FROM events) GROUP BY 1, 2")
def q_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = resume.in_windows(Tables(spark, sf_dir).events, "ts", "1 day", "1 hour", "event_type")
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n")
