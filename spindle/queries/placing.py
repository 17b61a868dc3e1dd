"""Shards, shuffles, mixtures and deterministic choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import frames
from spindle.functions.det import sql_uniform, uniform
from spindle.operators import mix, shard
from spindle.queries.registry import Tables, query

_RN = "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all their columns, numbered."""
    return shard.numbered(Tables(spark, sf_dir).documents, "doc_id")


def _place() -> Column:
    return F.col("position")


def _rows() -> Column:
    return F.col("n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position, count(*) OVER () AS n FROM lineitem")
def q_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.numbered(Tables(spark, sf_dir).lineitem, F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "position", "n")


@query(_RN + " SELECT doc_id, CAST(CASE WHEN p // (n // 7) < 7 THEN p // (n // 7) END AS BIGINT) AS shard, CAST(CASE WHEN p // (n // 7) < 7 THEN n // 7 - 1 - p % (n // 7) END AS BIGINT) AS place FROM r")
def q_shard_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", shard.floor_slice(_place(), _rows(), 7).cast("long").alias("shard"), shard.reversed_place(_place(), _rows(), 7).alias("place"))


@query(_RN + " SELECT doc_id, CAST(p // CAST(ceil(n / 7.0) AS BIGINT) AS BIGINT) AS shard FROM r")
def q_shard_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", shard.ceil_chunk(_place(), _rows(), 7).cast("long").alias("shard"))


@query(_RN + " SELECT doc_id, CAST(CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS shard FROM r")
def q_shard_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", shard.balanced(_place(), _rows(), 7).cast("long").alias("shard"))


@query(_RN + " SELECT doc_id, CAST(p % 7 AS BIGINT) AS shard, CAST(p // 64 AS BIGINT) AS chunk, CAST(((p - 3) % n + n) % n AS BIGINT) AS rotated FROM r")
def q_shard_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", shard.round_robin(_place(), 7).cast("long").alias("shard"), shard.fixed_size(_place(), 64).cast("long").alias("chunk"), shard.rotated(_place(), _rows(), 3).alias("rotated"))


@query(_RN + " SELECT doc_id, CAST(p % 4 AS BIGINT) AS rank, CAST(p // 4 % 3 AS BIGINT) AS worker, CAST(11 + p % 4 * 3 + p // 4 % 3 AS BIGINT) AS seed FROM r")
def q_shard_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", shard.two_level(_place(), _rows(), 4, 3).alias("s"))
    return s.select("doc_id", F.col("s.rank").cast("long").alias("rank"), F.col("s.worker").cast("long").alias("worker"), shard.worker_seed(11, F.col("s.rank"), 3, F.col("s.worker")).alias("seed"))


@query("SELECT n_nationkey, CAST(p // 4 AS BIGINT) AS rank, CAST(p % 4 AS BIGINT) AS worker, TRUE AS everyone FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation)")
def q_shard_few_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows for 8 x 4 workers: one at most for each, or everyone takes all."""
    rows = shard.numbered(Tables(spark, sf_dir).nation, "n_nationkey")
    few = rows.select("n_nationkey", shard.two_level(_place(), _rows(), 8, 4, allow_empty=True).alias("s"), shard.two_level(_place(), _rows(), 8, 4).alias("all"))
    return few.select("n_nationkey", F.col("s.rank").cast("long").alias("rank"), F.col("s.worker").cast("long").alias("worker"), (F.col("all.rank").isNull() & F.col("all.worker").isNull()).alias("everyone"))


@query("SELECT doc_id, e.epoch, row_number() OVER (PARTITION BY e.epoch ORDER BY md5(concat_ws(':', '5', 'shuffle', CAST(e.epoch AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id) AS rank FROM documents, (SELECT unnest([0, 1]) AS epoch) e")
def q_epoch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = shard.shuffled(shard.epochs(Tables(spark, sf_dir).documents.select("doc_id"), 2), 5, F.col("epoch"), "doc_id")
    placed = shard.numbered(keyed, "epoch", "order_key", "doc_id")
    first = placed.groupBy("epoch").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "epoch").select("doc_id", "epoch", (F.col("position") - F.col("first") + 1).alias("rank"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '5', 'file', source)), md5(concat_ws(':', '5', 'block', source, CAST(doc_id // 64 AS VARCHAR))), md5(concat_ws(':', '5', 'row', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS rank FROM documents")
def q_block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.select("doc_id", "source")
    keyed = shard.block_shuffled(docs, 5, "source", F.floor(F.col("doc_id") / 64), "doc_id")
    return shard.numbered(keyed, "k1", "k2", "k3", "doc_id").select("doc_id", F.col("position").alias("rank"))


@query("SELECT n_name, CAST(c * 25 + rn AS BIGINT) AS place FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation), (SELECT unnest(range(0, 3)) AS c) WHERE c * 25 + rn < 60")
def q_repeat_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.repeated_to(Tables(spark, sf_dir).nation.select("n_nationkey", "n_name"), 60, "n_nationkey").select("n_name", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS rn, count(*) OVER (PARTITION BY n_regionkey) AS have FROM nation)
SELECT n_regionkey, n_name, CAST(c * have + rn AS BIGINT) AS place FROM f, (SELECT unnest(range(0, 10)) AS c) WHERE c * have + rn < 3 + 4 * n_regionkey""")
def q_repeat_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    counts = t.region.select(F.col("r_regionkey").alias("n_regionkey"), (3 + 4 * F.col("r_regionkey")).cast("long").alias("take"))
    return mix.repeat_then_truncate(t.nation.select("n_regionkey", "n_name"), counts, "n_regionkey", "n_name", "take").select("n_regionkey", "n_name", F.col("place").cast("long").alias("place"))


@query(f"SELECT doc_id, CAST(CASE WHEN u < 0.5 THEN 0 WHEN u < 0.8 THEN 1 ELSE 2 END AS BIGINT) AS grp FROM (SELECT doc_id, {sql_uniform(9, 'group', 'doc_id')} AS u FROM documents)")
def q_group_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", mix.group_of([5.0, 3.0, 2.0], 9, "doc_id").cast("long").alias("grp"))


@query(f"SELECT doc_id, CASE WHEN u < 0.25 THEN 'a' WHEN u < 0.5 THEN 'b' ELSE 'c' END AS dataset FROM (SELECT doc_id, {sql_uniform(9, 'dataset', 'doc_id')} AS u FROM documents)")
def q_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", mix.dataset_of(["a", "b", "c"], [1.0, 1.0, 1.0], 9, "doc_id", replicas=[1, 1, 2]).alias("dataset"))


@query(f"""WITH b AS (SELECT source, count(*) AS c FROM documents GROUP BY source), p AS (SELECT source, sum(c) OVER (ORDER BY source) * 1.0 / sum(c) OVER () AS p FROM b)
SELECT event_id, (SELECT min(source) FROM p WHERE u < p.p) AS source FROM (SELECT event_id, {sql_uniform(9, 'bucket', 'event_id')} AS u FROM events)""")
def q_bucket_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    buckets = t.documents.groupBy("source").agg(F.count("*").alias("c"))
    return mix.bucket_of(t.events.select("event_id"), buckets, "c", "source", 9, "event_id").select("event_id", "source")


_U = lambda purpose, key: sql_uniform(2, purpose, key)
_MAP = "source, text"


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN 'en_text' WHEN lang = 'fr' THEN 'fr_text' ELSE list_element(list_sort(['alt_text', lang || '_text']), CAST(floor({_U('key', 'doc_id')} * 2) AS BIGINT) + 1) END AS key FROM documents")
def q_text_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_sort(F.array(F.lit("alt_text"), F.concat("lang", F.lit("_text"))))
    return Tables(spark, sf_dir).documents.select("doc_id", frames.by_priority(keys, ["en_text", "fr_text"], uniform(2, "key", "doc_id")).alias("key"))


@query(f"SELECT doc_id, CASE WHEN {_U('key', 'doc_id')} * 4.0 < 1.5 THEN 'short_a' WHEN {_U('key', 'doc_id')} * 4.0 < 3.0 THEN 'short_b' ELSE 'long' END AS key FROM documents")
def q_text_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.lit("short_a"), F.lit("short_b"), F.lit("long"))
    return Tables(spark, sf_dir).documents.select("doc_id", frames.by_frequency(keys, {"short.*": 3.0, "lo": 1.0}, uniform(2, "key", "doc_id")).alias("key"))


@query(f"SELECT doc_id, CASE WHEN {_U('alt', 'doc_id')} < 0.2 THEN source ELSE lang END AS caption, CASE WHEN {_U('skip', 'doc_id')} >= 0.0655 THEN source WHEN {_U('skip', 'doc_id')} >= 0.0 AND lang = 'en' THEN lang ELSE source END AS skipped FROM documents")
def q_caption_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    texts = F.map_filter(F.create_map(F.lit("long"), F.col("source"), F.lit("short"), F.when(F.col("lang") == "en", F.col("lang"))), lambda _, v: v.isNotNull())
    return docs.select("doc_id", frames.alternate(F.array("lang", "source"), 0.2, uniform(2, "alt", "doc_id")).alias("caption"), frames.by_skip(texts, ["long", "short", "long"], [0.0655, 0.0], uniform(2, "skip", "doc_id")).alias("skipped"))


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS have, CAST(sum(n_nationkey) AS BIGINT) AS weight, round(sum(sum(n_nationkey)) OVER (ORDER BY n_regionkey) * 1.0 / sum(sum(n_nationkey)) OVER (), 9) AS p FROM nation GROUP BY n_regionkey")
def q_cumulative_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = Tables(spark, sf_dir).nation.groupBy("n_regionkey").agg(F.count("*").alias("have"), F.sum("n_nationkey").alias("weight"))
    return mix.cdf(per, "weight", "n_regionkey").withColumn("p", F.round("p", 9))
