"""Packing, plans and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.det import sql_uniform
from spindle.plans import pack, plan, spans
from spindle.queries.registry import Tables, query

_TOKENS = "(n_chars // 4 + 1)"
#: Rows of one shard here; each source is cut into as many as its size asks for.
_SHARD = 64
_GREEDY = f"""
WITH RECURSIVE s AS (SELECT source, doc_id, CAST({_TOKENS} AS BIGINT) AS tokens, md5(concat_ws(':', '7', 'pack', CAST(doc_id AS VARCHAR))) AS order_key, ceil(count(*) OVER (PARTITION BY source) / {_SHARD}.0) AS shards FROM documents),
c AS (SELECT *, CAST(floor(CAST('0x' || substr(order_key, 9, 8) AS BIGINT) * shards / 4294967296) AS BIGINT) AS shard FROM s),
t AS (
  SELECT source, shard, tokens, row_number() OVER (PARTITION BY source, shard ORDER BY order_key, doc_id) AS rn FROM c WHERE tokens <= 8192
), p AS (
  SELECT source, shard, rn, tokens, tokens AS fill, CAST(0 AS BIGINT) AS bin FROM t WHERE rn = 1
  UNION ALL
  SELECT t.source, t.shard, t.rn, t.tokens, CASE WHEN p.fill + t.tokens > 8192 THEN t.tokens ELSE p.fill + t.tokens END, CASE WHEN p.fill + t.tokens > 8192 THEN p.bin + 1 ELSE p.bin END
  FROM p JOIN t ON t.source = p.source AND t.shard = p.shard AND t.rn = p.rn + 1
), b AS (SELECT source, shard, bin, count(*) AS n, sum(tokens) AS tokens FROM p GROUP BY source, shard, bin)
"""


def _captions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "n_chars", (F.floor(F.col("n_chars") / 4) + 1).cast("long").alias("tokens"))


@query(_GREEDY + "SELECT source, CAST(count(*) AS BIGINT) AS bins, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / (count(*) * 8192.0), 6) AS fill FROM b GROUP BY source")
def q_pack_greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pack.shard_of(_captions(Tables(spark, sf_dir)), "source", 7, "doc_id", size=_SHARD)
    place = F.struct("order_key", "doc_id").alias("place")
    bins = pack.greedy(cut.select("source", "shard", "tokens", place), ["source", "shard"], "place", "tokens", 8192)
    return bins.groupBy("source").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * 8192.0), 6).alias("fill"))


@query()
def q_pack_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _captions(Tables(spark, sf_dir)).withColumn("group_name", F.when(F.pmod("doc_id", F.lit(4)) == 0, "video").otherwise("image"))
    cut = pack.shard_of(rows, "source", 7, "doc_id").withColumn("shard", F.concat_ws("/", "source", "shard"))
    limits = pack.Limits(expected=8192, per_sample=8192, maximum=9216, prefer_buffer_before=4096, buffer=50)
    packed = pack.buffered(cut.select("shard", "group_name", F.col("doc_id").alias("id"), "tokens", F.lit(2).alias("items"), "order_key"), limits, {"image": 3.0, "video": 1.0}, ("image",))
    return packed.groupBy("shard", "bin").agg(F.count("*").alias("n"), F.sum("n").alias("tokens"), F.max(F.col("start") + F.col("n")).alias("end"))


def _items(t: Tables) -> DataFrame:
    """Two items for each caption: its text, then an image of a size that follows from its id."""
    docs = _captions(t)
    frames = F.pmod("doc_id", F.lit(5)).cast("long") + 1
    video = F.pmod("doc_id", F.lit(3)) == 0
    text = docs.select("doc_id", F.lit(0).alias("place"), F.lit("text").alias("type"), "tokens", F.lit(0).cast("long").alias("frames"), F.lit(0).alias("loss"))
    image = docs.select("doc_id", F.lit(1).alias("place"), F.when(video, "vae_video").otherwise("vae_image").alias("type"), F.when(video, frames * 16).otherwise(64).cast("long").alias("tokens"), F.when(video, frames).otherwise(0).alias("frames"), F.lit(1).alias("loss"))
    return text.union(image).withColumnRenamed("tokens", "n").withColumn("frame_delta", F.lit(None).cast("int"))


_ITEMS = f"""
WITH c AS (SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS tokens FROM documents),
items AS (
  SELECT doc_id, 0 AS place, 'text' AS type, tokens AS n, 0 AS frames, 0 AS loss FROM c
  UNION ALL
  SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN 'vae_video' ELSE 'vae_image' END, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5 + 1) * 16 ELSE 64 END, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 1 ELSE 0 END, 1 FROM c
)
"""
_DROP = f"(place = 0 AND {sql_uniform(3, 'dropout', 'doc_id', 'place')} < 0.1)"


def _spanned(t: Tables, drop: bool) -> DataFrame:
    items = _items(t)
    gone = plan.dropped(F.col("type"), F.when(F.col("type") == "text", 1).otherwise(0), F.col("place"), 3, F.col("doc_id")) if drop else None
    return spans.spans(items, "doc_id", dropped=gone)


@query(
    _ITEMS
    + """SELECT doc_id, CAST(place AS BIGINT) AS place, type, CAST(n + 2 AS BIGINT) AS len,
  CAST(sum(n + 2) OVER w - (n + 2) AS BIGINT) AS "start", CAST(CASE WHEN place = 0 THEN 0 ELSE (sum(n + 2) OVER w) - (n + 2) END AS BIGINT) AS rope,
  CASE WHEN type = 'text' THEN 'causal' ELSE 'noise' END AS mode,
  CAST(CASE WHEN loss = 1 THEN sum(n + 2) OVER w - (n + 2) + 1 END AS BIGINT) AS mse_start
FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def q_plan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spanned(Tables(spark, sf_dir), False).select("doc_id", F.col("place").cast("long").alias("place"), "type", "len", "start", "rope", "mode", F.col("mse_start").cast("long").alias("mse_start"))


@query(
    _ITEMS
    + f""", d AS (SELECT *, {_DROP} AS gone FROM items)
SELECT type, CAST(count(*) AS BIGINT) AS items, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(CASE WHEN gone THEN 0 ELSE n + 2 END) AS BIGINT) AS tokens FROM d GROUP BY type"""
)
def q_cond_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spanned(Tables(spark, sf_dir), True).groupBy("type").agg(F.count("*").alias("items"), F.sum(F.col("dropped").cast("long")).alias("dropped"), F.sum("len").alias("tokens"))


@query(
    _ITEMS
    + """, s AS (SELECT doc_id, place, n + 2 AS len, CASE WHEN type = 'text' THEN 'causal' ELSE 'noise' END AS mode FROM items)
SELECT q.doc_id, CAST(q.place AS BIGINT) AS q_place, CAST(k.place AS BIGINT) AS k_place,
  CAST(CASE WHEN q.place = k.place AND q.mode = 'causal' THEN q.len * (q.len + 1) // 2 WHEN q.place = k.place THEN q.len * q.len
       WHEN k.mode <> 'noise' AND k.place < q.place THEN q.len * k.len ELSE 0 END AS BIGINT) AS pairs
FROM s q JOIN s k ON q.doc_id = k.doc_id"""
)
def q_span_mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = spans.span_mask(_spanned(Tables(spark, sf_dir), False), ["doc_id"])
    return masked.select("doc_id", F.col("q_place").cast("long").alias("q_place"), F.col("k_place").cast("long").alias("k_place"), "pairs")


@query(
    _ITEMS
    + """SELECT doc_id, CAST(sum(n + 2) AS BIGINT) AS len, CAST(greatest(0, 4608 - sum(n + 2)) AS BIGINT) AS padding, CAST(count(*) + CASE WHEN sum(n + 2) < 4608 THEN 1 ELSE 0 END AS BIGINT) AS splits FROM items GROUP BY doc_id"""
)
def q_pad_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _spanned(Tables(spark, sf_dir), False).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "len", "mode"))).alias("s"))
    padded = lists.select("doc_id", F.col("s.len").alias("lens"), spans.padded_splits(F.col("s.len"), F.col("s.mode"), 4608).alias("p"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return padded.select("doc_id", add(F.col("lens")).alias("len"), (add(F.col("p.lens")) - add(F.col("lens"))).alias("padding"), F.size("p.modes").cast("long").alias("splits"))


@query(
    "SELECT doc_id, round(CASE WHEN n_chars // 4 > 0 THEN 1.0 / sqrt(CAST(n_chars // 4 AS DOUBLE)) ELSE 0.0 END, 9) AS by_square, round(CASE WHEN n_chars // 4 > 0 THEN 1.0 / CAST(n_chars // 4 AS DOUBLE) ELSE 0.0 END, 9) AS by_sample FROM documents"
)
def q_loss_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("n_chars") / 4)
    return Tables(spark, sf_dir).documents.select("doc_id", F.round(plan.loss_weight(n), 9).alias("by_square"), F.round(plan.loss_weight(n, "sample"), 9).alias("by_sample"))


def _turns(t: Tables) -> DataFrame:
    """A conversation as an array of turns; every third one starts with an image mark."""
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise("system")
    value = F.when((F.pmod("conv_id", F.lit(3)) == 0) & (F.col("role") == "user"), F.concat(F.lit("<image> "), F.col("text"))).otherwise(F.col("text"))
    turn = t.conversations.select("conv_id", "turn", F.struct(role.alias("from"), value.alias("value")).alias("t"))
    return turn.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]).alias("turns"))


_CHAT = """
WITH t AS (SELECT conv_id, role, conv_id % 3 = 0 AND role = 'user' AS marked, text FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, CAST(sum(CASE WHEN NOT marked THEN 1 WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS texts,
  CAST(sum(CASE WHEN marked THEN 1 ELSE 0 END) AS BIGINT) AS images, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS with_loss
FROM t GROUP BY conv_id"""


@query(_CHAT)
def q_chat_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _turns(Tables(spark, sf_dir)).select("conv_id", plan.chat_elements(F.col("turns"), F.lit(4)).alias("e"))
    n = lambda f: F.size(F.filter("e", f)).cast("long")
    return e.where(F.size("e") > 0).select("conv_id", n(lambda x: x["type"] == "text").alias("texts"), n(lambda x: x["type"] == "image").alias("images"), n(lambda x: x["has_loss"] == 1).alias("with_loss"))


@query("SELECT conv_id, max(CASE WHEN role = 'assistant' AND length(text) > 0 THEN 1 ELSE 0 END) = 1 AS has_loss FROM conversations GROUP BY conv_id")
def q_chat_has_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _turns(Tables(spark, sf_dir)).select("conv_id", plan.chat_plan(plan.chat_elements(F.col("turns"), F.lit(4))).alias("p"))
    return e.select("conv_id", plan.has_loss(F.col("p")).alias("has_loss"))


@query(f"SELECT doc_id, CAST({_TOKENS} + 4 AS BIGINT) AS total, {_TOKENS} + 4 <= 1024 AS fits, {_TOKENS} + 4 < 1024 AS fits_mandatory FROM documents")
def q_sample_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.floor(F.col("n_chars") / 4) + 1).cast("long")
    p = plan.text_to_image()
    return Tables(spark, sf_dir).documents.select("doc_id", plan.total_tokens(n, p).alias("total"), plan.fits(n, p, 1024).alias("fits"), plan.fits(n, p, 1024, True).alias("fits_mandatory"))


@query("SELECT p_partkey, CAST(p_size % 4 + 2 AS BIGINT) AS frames, CAST(5 * (p_size % 4 + 1) AS BIGINT) AS delta, CAST(1 AS BIGINT) AS starts, CAST(1 AS BIGINT) AS ends FROM part")
def q_video_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 4 + 2
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * 5)
    p = Tables(spark, sf_dir).part.select("p_partkey", plan.add_video(frames, True).alias("p"))
    count = lambda f: F.size(F.filter("p", f)).cast("long")
    return p.select("p_partkey", F.size("p").cast("long").alias("frames"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["frame_delta"], F.lit(0))).alias("delta"), count(lambda x: x["split_start"]).alias("starts"), count(lambda x: x["split_end"]).alias("ends"))
