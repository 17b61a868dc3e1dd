"""Smaller operators: embeddings, patches, partitions, captions, buckets, metadata, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import frames, geometry
from spindle.functions.det import sql_uniform, uniform
from spindle.operators import records
from spindle.queries.registry import Tables, query
from spindle.ship import spread
from spindle.sources import readers
from spindle.streaming import resume

_add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


@query("""SELECT p_partkey, round(list_sum(list_transform(range(0, 8), lambda i: sin(p_size * pow(10000.0, -i / 8.0)) + cos(p_size * pow(10000.0, -i / 8.0)))), 7) AS embedding,
  round(list_sum(list_transform(range(0, 4), lambda i: cos(p_size * pow(10000.0, -i / 4.0)) - sin(p_size * pow(10000.0, -i / 4.0)))), 7) AS timestep FROM part""")
def q_sincos_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = geometry.timestep_embedding(F.col("p_size").cast("double"), 8)
    p = Tables(spark, sf_dir).part.select("p_partkey", geometry.sincos_embedding(F.col("p_size").cast("double"), 16).alias("e"), t.alias("t"))
    return p.select("p_partkey", F.round(_add(F.col("e")), 7).alias("embedding"), F.round(_add(F.slice("t", 1, 4)) - _add(F.slice("t", 5, 4)), 7).alias("timestep"))


@query("SELECT vec_id, CAST(4 AS BIGINT) AS patches, round(embedding[1] + embedding[2] + embedding[9] + embedding[10], 4) AS first_patch FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def q_patchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 values as one channel of 8 x 8, of which the first quarter of a patch is summed."""
    e = Tables(spark, sf_dir).embeddings.select("vec_id", geometry.patchified(F.transform("embedding", lambda x: x.cast("double")), F.lit(1), F.lit(8), F.lit(8), 4).alias("p"))
    corner = F.get("p", 0)
    return e.select("vec_id", F.size("p").cast("long").alias("patches"), F.round(corner[0] + corner[1] + corner[4] + corner[5], 4).alias("first_patch"))


@query("SELECT p_partkey, CAST(ceil((p_size * 9 + 5) / 16.0) * 4 AS BIGINT) AS cells, CAST((p_size * 9 + 5) * 50 AS BIGINT) AS area, CAST(floor(ceil((p_size * 9 + 5) / 16.0) * 4 * 0.25) AS BIGINT) AS blank FROM part")
def q_patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("p_size") * 9 + 5
    g = Tables(spark, sf_dir).part.select("p_partkey", geometry.patch_grid(h, F.lit(50), 16).alias("g"))
    n = F.size("g")
    area = F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x["h"] * x["w"])
    return g.select("p_partkey", n.cast("long").alias("cells"), area.alias("area"), F.size(F.array_distinct(geometry.blank_cells(n, 0.25, 3, F.col("p_partkey")))).cast("long").alias("blank"))


@query("SELECT p_partkey, CAST(list_sum(list_transform(range(0, p_size), lambda r: CAST(floor(r * 8 / CAST(p_size AS DOUBLE)) AS BIGINT) * 8)) AS BIGINT) AS total FROM part")
def q_interpolated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = geometry.interpolated_position_ids(F.col("p_size"), F.lit(1), 8)
    return Tables(spark, sf_dir).part.select("p_partkey", F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"SELECT p_partkey, CAST(p_size AS BIGINT) AS total, CAST(1 + floor({sql_uniform(5, 'parts', 'p_partkey')} * p_size) AS BIGINT) AS parts FROM part")
def q_integer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(Tables(spark, sf_dir).part.select("p_partkey", "p_size")).select("p_partkey", frames.integer_parts(F.col("p_size"), 5, F.col("p_partkey")).alias("x"))
    return p.select("p_partkey", F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.size("x").cast("long").alias("parts"))


@query(f"SELECT doc_id, CASE WHEN {sql_uniform(2, 'en', 'doc_id')} < 0.5 THEN source ELSE lang END AS caption FROM documents")
def q_english_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.create_map(F.lit("a_en_x_text"), F.col("source"), F.lit("b_fr_text"), F.lit("non"), F.lit("c_en_text"), F.col("lang"))
    return Tables(spark, sf_dir).documents.select("doc_id", frames.english_caption(texts, uniform(2, "en", "doc_id")).alias("caption"))


@query()
def q_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = lambda p: uniform(2, p, "p_partkey")
    n = F.col("p_size") % 5 + 2
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(F.concat(F.lit("step "), i.cast("string")), F.lit("other")))
    e = Tables(spark, sf_dir).part.select("p_partkey", n.alias("images"), frames.edit_pair(n, steps, u("a"), u("b"), u("c"), u("d")).alias("e"))
    return e.select("p_partkey", "images", "e.start", "e.end", "e.joined", F.size("e.texts").alias("texts"))


@query("SELECT r_name, ratio, CAST(h AS BIGINT) AS h, CAST(w AS BIGINT) AS w, CAST(49 AS BIGINT) AS frames FROM region, (VALUES ('0.5', 512, 1024), ('1.0', 640, 640)) b(ratio, h, w)")
def q_bucket_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.create_map(F.lit("0.5"), F.array(F.lit(512), F.lit(1024)), F.lit("1.0"), F.array(F.lit(640), F.lit(640)))
    b = records.bucket_table(Tables(spark, sf_dir).region.select("r_name", sizes.alias("m")), "m")
    return b.select("r_name", "ratio", *(F.col(c).cast("long").alias(c) for c in ("h", "w", "frames")))


@query("SELECT s_suppkey, CAST(unnest(range(0, s_nationkey)) AS BIGINT) AS row_group FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey > 0")
def q_row_group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).supplier.where("s_nationkey > 0")
    meta = s.where("s_suppkey % 3 <> 0").select("s_suppkey", F.col("s_nationkey").alias("num_row_groups"))
    return readers.metadata_of(s.select("s_suppkey"), meta, "s_suppkey").select("s_suppkey", F.col("row_group").cast("long").alias("row_group"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def q_without_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).supplier.select("s_suppkey")
    return readers.without_metadata(s, s.where("s_suppkey % 3 <> 0"), "s_suppkey")


@query("SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN n_chars >= 3000 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM documents GROUP BY source")
def q_kept_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("source", "n_chars")
    return records.kept_totals(d, d.where("n_chars >= 3000"), "source")


@query("SELECT CAST(max(CAST(substr(c_name, 10) AS BIGINT)) AS VARCHAR) AS step FROM customer")
def q_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Tables(spark, sf_dir).customer.select(F.regexp_replace(F.substring("c_name", 10, 30), "^0+", "").alias("step"))
    return records.latest_numbered(names.union(names.sparkSession.createDataFrame([("latest",)], "step string")), "step")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, c_custkey FROM customer")
def q_row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.row_positions(spark, f"{sf_dir}/customer.parquet", "c_custkey").select("row_index", "c_custkey")


@query("SELECT event_id, CAST(event_id // 10000 AS BIGINT) AS epoch, event_id % 2 = 0 AS folder FROM events")
def q_epoch_of_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("clip"), F.when(F.col("event_id") % 2 == 0, "/").otherwise(".mp4"))
    return Tables(spark, sf_dir).events.select("event_id", resume.epoch_of(F.col("event_id"), F.lit(10000)).alias("epoch"), frames.is_folder(path).alias("folder"))


@query("SELECT doc_id, n_chars % 90 > 45 AS long_clip, lang IN ('fr', 'de') AS normal FROM documents")
def q_row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    abnormal = F.when(F.col("lang") == "en", True).when(F.col("lang") == "es", True)
    return Tables(spark, sf_dir).documents.select("doc_id", (F.col("n_chars") % 90 > 45).alias("long_clip"), records.normal_caption(abnormal).alias("normal"))


@query("SELECT vec_id, CAST(64 AS BIGINT) AS size, TRUE AS ok FROM embeddings")
def q_float_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.repeat(F.lit("0000803F"), 64))
    s = readers.float_tensor(raw, F.array(F.lit(4), F.lit(4), F.lit(4)))
    return Tables(spark, sf_dir).embeddings.select("vec_id", s["size"].cast("long").alias("size"), s["ok"].alias("ok"))
