"""Geometry, frames and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import frames, geometry
from spindle.functions.det import sql_uniform, uniform
from spindle.operators import records
from spindle.queries.registry import Tables, query
from spindle.ship import spread

# An image size for each line: width and height from part and supplier keys; lines are told apart by all their numbers.
_W, _H = "(l_partkey % 1900 + 64)", "(l_suppkey * 37 % 1700 + 64)"
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_IDS = ", ".join(_LINE)


def _w() -> Column:
    return F.col("l_partkey") % 1900 + 64


def _h() -> Column:
    return F.col("l_suppkey") * 37 % 1700 + 64


_RATIOS = [0.5, 0.75, 1.0, 1.333, 1.777]
_SIZES = [(512, 1024), (576, 768), (640, 640), (768, 576), (1024, 576)]
_LIST = "[0.5, 0.75, 1.0, 1.333, 1.777]"
_NEAREST = f"(list_position(list_transform({_LIST}, lambda x: abs(x - r)), list_min(list_transform({_LIST}, lambda x: abs(x - r)))) - 1)"


@query(f"WITH t AS (SELECT {_IDS}, CAST({_W} AS DOUBLE) / {_H} AS r FROM lineitem) SELECT CAST({_NEAREST} AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, round(min(r), 9) AS low, round(max(r), 9) AS high FROM t GROUP BY 1")
def q_bucket_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _w().cast("double") / _h()
    t = Tables(spark, sf_dir).lineitem.select(r.alias("r"), geometry.nearest(r, _RATIOS).cast("long").alias("bucket"))
    return t.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.min("r"), 9).alias("low"), F.round(F.max("r"), 9).alias("high"))


@query("""WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CAST(rn // 64 AS BIGINT) AS batch, CAST(rn % 64 AS BIGINT) AS place FROM t WHERE rn // 64 < n // 64""")
def q_bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority")
    b = records.full_batches(o, "o_orderpriority", ["o_orderkey"], 64)
    return b.select("o_orderkey", "o_orderpriority", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


_OVERRIDE = "WITH t AS (SELECT {ids}, CAST({w} AS DOUBLE) / {h} AS r FROM lineitem), b AS (SELECT *, {n} AS i FROM t) ".format(
    ids=_IDS, w=_W, h=_H, n="(list_position(list_transform([0.5, 0.75, 1.0, 768.0/576, 1024.0/576], lambda x: abs(x - r)), list_min(list_transform([0.5, 0.75, 1.0, 768.0/576, 1024.0/576], lambda x: abs(x - r)))) - 1)"
)


@query(_OVERRIDE + f"SELECT {_IDS}, CAST(floor([512, 576, 640, 768, 1024][i + 1] * 0.5 / 64) * 64 AS BIGINT) AS w, CAST(floor([1024, 768, 640, 576, 576][i + 1] * 0.5 / 64) * 64 AS BIGINT) AS h FROM b")
def q_resolution_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geometry.override_resolution(_w(), _h(), _SIZES, 256)
    return Tables(spark, sf_dir).lineitem.select(*_LINE, s["w"].cast("long").alias("w"), s["h"].cast("long").alias("h"))


def _scaled(w: str, h: str, s: str) -> tuple[str, str]:
    one = lambda x: f"greatest(16.0, round_even(round_even({x} * {s}, 0) / 16, 0) * 16)"
    return one(w), one(h)


_S0 = "greatest(least(1024.0 / greatest(w, h), 1.0), 256.0 / least(w, h))"
_W1, _H1 = _scaled("w", "h", "s")
_W2, _H2 = _scaled("w1", "h1", "(500000.0 / (w1 * h1))")
_W3, _H3 = _scaled("w2", "h2", "(1024.0 / greatest(w2, h2))")


@query(f"""WITH a AS (SELECT {_IDS}, CAST({_W} AS DOUBLE) AS w, CAST({_H} AS DOUBLE) AS h FROM lineitem), b AS (SELECT *, {_S0} AS s FROM a), c AS (SELECT *, {_W1} AS w1, {_H1} AS h1 FROM b),
d AS (SELECT *, CASE WHEN w1 * h1 > 500000 THEN {_W2} ELSE w1 END AS w2, CASE WHEN w1 * h1 > 500000 THEN {_H2} ELSE h1 END AS h2 FROM c)
SELECT {_IDS}, CAST(CASE WHEN greatest(w2, h2) > 1024 THEN {_W3} ELSE w2 END AS BIGINT) AS w, CAST(CASE WHEN greatest(w2, h2) > 1024 THEN {_H3} ELSE h2 END AS BIGINT) AS h FROM d""")
def q_resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geometry.resize_dims(_w(), _h(), 1024, 256, 16, 500000)
    return Tables(spark, sf_dir).lineitem.select(*_LINE, s["w"].cast("long").alias("w"), s["h"].cast("long").alias("h"))


@query(f"""WITH a AS (SELECT {_IDS}, CAST({_W} AS DOUBLE) AS w, CAST({_H} AS DOUBLE) AS h FROM lineitem),
b AS (SELECT *, CASE WHEN h / w > 0.5625 THEN floor(w * 0.5625) ELSE h END AS nh, CASE WHEN h / w > 0.5625 THEN w ELSE floor(h / 0.5625) END AS nw,
  CASE WHEN h / w >= 0.5625 THEN floor(w * 0.5625) ELSE h END AS ch, CASE WHEN h / w >= 0.5625 THEN w ELSE floor(h / 0.5625) END AS cw FROM a)
SELECT {_IDS}, CAST(round_even((h - nh) / 2.0, 0) AS BIGINT) AS i, CAST(round_even((w - nw) / 2.0, 0) AS BIGINT) AS j, CAST(nh AS BIGINT) AS h, CAST(nw AS BIGINT) AS w,
  CAST(floor((h - ch) / 2) AS BIGINT) AS top, CAST(floor((w - cw) / 2) AS BIGINT) AS left_edge FROM b""")
def q_center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = geometry.center_crop(_h(), _w(), F.lit(720), F.lit(1280)), geometry.crop_box(_h(), _w(), F.lit(720), F.lit(1280))
    t = Tables(spark, sf_dir).lineitem.select(*_LINE, a.alias("a"), b.alias("b"))
    return t.select(*_LINE, *(F.col(f"a.{c}").cast("long").alias(c) for c in ("i", "j", "h", "w")), F.col("b.top").cast("long").alias("top"), F.col("b.left").cast("long").alias("left_edge"))


_RC = sql_uniform(4, "crop", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH a AS (SELECT {_IDS}, CAST({_W} AS DOUBLE) AS w, CAST({_H} AS DOUBLE) AS h, {_RC} AS u FROM lineitem),
b AS (SELECT *, w / h >= 768.0 / 512 AS wide, CASE WHEN w / h >= 768.0 / 512 THEN 512 ELSE round_even(768 * (h / w), 0) END AS rh, CASE WHEN w / h >= 768.0 / 512 THEN round_even(512 * (w / h), 0) ELSE 768 END AS rw FROM a)
SELECT {_IDS}, CAST(rh AS BIGINT) AS resize_h, CAST(rw AS BIGINT) AS resize_w, CAST(CASE WHEN wide THEN 0 ELSE floor(u * (rh - 512 + 1)) END AS BIGINT) AS top, CAST(CASE WHEN wide THEN floor(u * (rw - 768 + 1)) ELSE 0 END AS BIGINT) AS left_edge FROM b""")
def q_resize_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geometry.resize_crop(_h().cast("double"), _w().cast("double"), 512, 768, uniform(4, "crop", *_LINE))
    return Tables(spark, sf_dir).lineitem.select(*_LINE, s.alias("s")).select(*_LINE, *(F.col(f"s.{c}").cast("long").alias(a) for c, a in (("resize_h", "resize_h"), ("resize_w", "resize_w"), ("top", "top"), ("left", "left_edge"))))


@query(f"SELECT CAST(l_linenumber AS BIGINT) AS line, CAST(sum(CAST({_W} AS BIGINT) * {_H} // 256) AS BIGINT) AS image, CAST(sum(((CAST(l_quantity AS BIGINT) - 1) // 4 + 1) * (CAST({_W} AS BIGINT) * {_H} // 256)) AS BIGINT) AS video4, CAST(sum(((CAST(l_quantity AS BIGINT) - 1) // 8 + 1) * (CAST({_W} AS BIGINT) * {_H} // 256)) AS BIGINT) AS video8 FROM lineitem GROUP BY 1")
def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return Tables(spark, sf_dir).lineitem.groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(
        F.sum(geometry.image_tokens(_w(), _h(), 16)).alias("image"), F.sum(geometry.video_tokens(q, _w(), _h())).alias("video4"), F.sum(geometry.video_tokens(q, _w(), _h(), 8)).alias("video8")
    )


@query("SELECT p_partkey, CAST(list_sum(ids) AS BIGINT) AS total, CAST(len(ids) AS BIGINT) AS n, CAST(ids[len(ids)] AS BIGINT) AS final FROM (SELECT p_partkey, flatten(list_transform(range(0, p_size % 7 + 1), lambda r: list_transform(range(0, p_size % 5 + 1), lambda c: r * 70 + c))) AS ids FROM part)")
def q_position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = geometry.position_ids(F.col("p_size") % 7 + 1, F.col("p_size") % 5 + 1, 70)
    t = Tables(spark, sf_dir).part.select("p_partkey", ids.alias("ids"))
    return t.select("p_partkey", F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("ids").cast("long").alias("n"), F.element_at("ids", -1).cast("long").alias("final"))


_BOX = "CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey % 200 AS DOUBLE) AS y0, CAST(l_partkey % 300 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 200 + l_linenumber * 9 AS DOUBLE) AS y1"


@query(f"""WITH b AS (SELECT {_IDS}, {_BOX} FROM lineitem),
c AS (SELECT *, (x0 + x1) / 2 - 170 AS ox, (y0 + y1) / 2 - 120 AS oy FROM b),
d AS (SELECT *, greatest(abs(ox) - 0.1 * ((x1 - x0) + 60), 0) * sign(ox) AS rx, greatest(abs(oy) - 0.1 * ((y1 - y0) + 40), 0) * sign(oy) AS ry, sqrt(ox * ox + oy * oy) AS norm FROM c),
e AS (SELECT *, CASE WHEN norm > 0 THEN rx / norm ELSE 0 END AS dx, CASE WHEN norm > 0 THEN ry / norm ELSE 0 END AS dy,
  greatest(least(x1, 200) - greatest(x0, 140) + 1, 0) * greatest(least(y1, 140) - greatest(y0, 100) + 1, 0) AS inter FROM d)
SELECT concat_ws(',', CASE WHEN dx < -0.5 THEN 'left of' END, CASE WHEN dx > 0.5 THEN 'right of' END, CASE WHEN dy < -0.5 THEN 'above' END, CASE WHEN dy > 0.5 THEN 'below' END) AS relation,
  CAST(count(*) AS BIGINT) AS n, round(sum(inter / ((x1 - x0 + 1) * (y1 - y0 + 1) + 61 * 41 - inter)), 5) AS iou FROM e GROUP BY 1""")
def q_relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") % 200
    box = F.array(*(c.cast("double") for c in (x, y, x + F.col("l_quantity"), y + F.col("l_linenumber") * 9)))
    target = F.array(*(F.lit(float(v)) for v in (140, 100, 200, 140)))
    boxes = Tables(spark, sf_dir).lineitem.select(box.alias("box"))
    t = boxes.select(F.array_join(geometry.relative_position(F.col("box"), target), ",").alias("relation"), geometry.iou(F.col("box"), target).alias("iou"))
    return t.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 5).alias("iou"))


@query()
def q_topk_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda i: F.array(*(F.abs(F.col("embedding")[i + k]).cast("double") * 100 + (50 if k in (2, 3) else 0) for k in range(4)), F.abs(F.col("embedding")[i + 4]).cast("double"))
    t = Tables(spark, sf_dir).embeddings.select("vec_id", geometry.top_boxes(F.array(*(box(i) for i in range(0, 60, 5))), 0.01, 8).alias("top"))
    return t.select("vec_id", F.size("top").alias("candidates"), F.size(geometry.suppressed(F.col("top"), 0.5)).alias("kept"))


_LEN = "(p_size * 7 + 1)"


def _len() -> Column:
    return F.col("p_size") * 7 + 1


@query(f"""WITH a AS (SELECT p_partkey, {_LEN} AS n, least(16, {_LEN}) AS m FROM part),
b AS (SELECT p_partkey, n, m, list_transform(range(0, m), lambda i: CAST(floor((CAST(floor(i * (CAST(n AS DOUBLE) / m)) AS BIGINT) + (CASE WHEN i + 1 = m THEN n ELSE CAST(floor((i + 1) * (CAST(n AS DOUBLE) / m)) AS BIGINT) END) - 1) / 2.0) AS BIGINT)) AS f FROM a)
SELECT p_partkey, CAST(16 AS BIGINT) AS frames, CAST(list_sum(f) + (16 - m) * f[len(f)] AS BIGINT) AS total FROM b""")
def q_frame_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).part.select("p_partkey", frames.interval_frames(_len(), 16).alias("f"))
    return t.select("p_partkey", F.size("f").cast("long").alias("frames"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""WITH a AS (SELECT p_partkey, {_LEN} AS n, greatest(1, CAST(ceil({_LEN} / 24.0 / 0.5) AS BIGINT)) AS steps FROM part),
b AS (SELECT p_partkey, list_filter(list_transform(range(0, steps), lambda i: CAST(round_even((0.25 + i * 0.5) * 24.0, 0) AS BIGINT)), lambda f: f < n) AS f FROM a)
SELECT p_partkey, CAST(len(f) AS BIGINT) AS frames, CAST(coalesce(list_sum(f), 0) AS BIGINT) AS total FROM b""")
def q_frame_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).part.select("p_partkey", frames.fps_frames(_len(), 2.0, 24.0).alias("f"))
    return t.select("p_partkey", F.size("f").cast("long").alias("frames"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_UC = sql_uniform(6, "clip", "p_partkey")


@query(f"""WITH a AS (SELECT p_partkey, {_LEN} AS n, 10 + CAST(floor({_UC} * ({_LEN} - least({_LEN}, 61) - 20 + 1)) AS BIGINT) AS s FROM part WHERE 61 <= {_LEN} - 20)
SELECT p_partkey, s AS start_frame, s + 60 AS end_frame, CAST(list_sum(list_transform(range(0, 16), lambda i: CAST(floor(s + i * (60.0 / 15)) AS BIGINT))) AS BIGINT) AS total FROM a""")
def q_frame_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).part.where(frames.long_enough(_len(), 16, 4, 10)).select("p_partkey", frames.clip_frames(_len(), 16, 4, 10, uniform(6, "clip", "p_partkey")).alias("f"))
    return t.select("p_partkey", F.get("f", 0).cast("long").alias("start_frame"), F.element_at("f", -1).cast("long").alias("end_frame"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_US = sql_uniform(6, "stride", "p_partkey")


@query(f"""WITH a AS (SELECT p_partkey, {_LEN} AS n, list_filter([1, 2, 4], lambda s: {_LEN} // s >= 9) AS ok FROM part),
b AS (SELECT *, ok[CAST(floor({_US} * len(ok)) AS BIGINT) + 1] AS stride FROM a WHERE len(ok) > 0),
c AS (SELECT *, list_max(list_filter([9, 17, 33], lambda x: n // stride >= x)) AS length FROM b)
SELECT p_partkey, CAST(stride AS BIGINT) AS stride, CAST(length AS BIGINT) AS length, CAST(round_even((n - 1 - stride * (length - 1)) / 2.0, 0) AS BIGINT) AS start_frame FROM c""")
def q_frame_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames.adaptive(_len(), [9, 17, 33], [1, 2, 4], uniform(6, "stride", "p_partkey"), F.lit(0.0), "center")
    t = spread(Tables(spark, sf_dir).part.select("p_partkey", "p_size")).select("p_partkey", s.alias("s")).where("s IS NOT NULL")
    return t.select("p_partkey", *(F.col(f"s.{c}").cast("long").alias(a) for c, a in (("stride", "stride"), ("length", "length"), ("start", "start_frame"))))


@query(f"""WITH a AS (SELECT p_partkey, {_LEN} AS n, {_US} AS u, {sql_uniform(6, 'length', 'p_partkey')} AS v FROM part),
b AS (SELECT *, CASE WHEN u < 0.5 OR n // 3 < 4 THEN 1 ELSE 3 END AS stride FROM a WHERE n >= 4),
c AS (SELECT *, CASE WHEN v < 1.0/3 OR n // stride < 8 THEN 4 WHEN v < 2.0/3 OR n // stride < 16 THEN 8 ELSE 16 END AS length FROM b)
SELECT CAST(stride AS BIGINT) AS stride, CAST(length AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1, 2""")
def q_frame_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames.advanced(_len(), [frames.Strategy(1, (4, 8, 16), 0.5), frames.Strategy(3, (4, 8, 16), 0.5)], uniform(6, "stride", "p_partkey"), uniform(6, "length", "p_partkey"), F.lit(0.0))
    t = spread(Tables(spark, sf_dir).part.select("p_partkey", "p_size")).select(s.alias("s")).where("s IS NOT NULL")
    return t.groupBy(F.col("s.stride").cast("long").alias("stride"), F.col("s.length").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, CAST(event_id % 500 AS BIGINT) AS frame FROM events),
k AS (SELECT *, greatest(len(list_filter([0, 48, 96, 250, 400], lambda x: x < frame)) - 1, 0) AS keyframe FROM e)
SELECT CAST(keyframe AS BIGINT) AS keyframe, CAST(count(*) AS BIGINT) AS n, CAST(sum(frame) AS BIGINT) AS total FROM k GROUP BY 1""")
def q_keyframe_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*map(F.lit, (0, 48, 96, 250, 400)))
    e = Tables(spark, sf_dir).events.select((F.col("event_id") % 500).alias("frame"))
    return e.groupBy(frames.keyframe_of(F.col("frame"), keys).cast("long").alias("keyframe")).agg(F.count("*").alias("n"), F.sum("frame").alias("total"))


@query("SELECT s_nationkey, CAST(sum(s_suppkey) AS BIGINT) AS count FROM supplier GROUP BY s_nationkey")
def q_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.histogram(Tables(spark, sf_dir).supplier, "s_nationkey", count="s_suppkey")


@query("SELECT event_id, round(3.0 * t / (1 + 2.0 * t), 7) AS t FROM (SELECT event_id, 1 / (1 + exp(-value / 100)) AS t FROM events)")
def q_flow_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select("event_id", F.round(geometry.flow_time(F.col("value") / 100, 3.0), 7).alias("t"))
