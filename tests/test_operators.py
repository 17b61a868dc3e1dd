"""Operators on small tables, and functions on hand-made values."""

import io
import json
import tarfile
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle import catalog
from spindle.functions import answers, clean, det, frames, geometry, prompts, text, tokens
from spindle.operators import metrics, mix, records, shard
from spindle.plans import plan, spans
from spindle.sources import readers, sinks
from spindle.streaming import carry, resume


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(r) == 1 else tuple(r)


def test_shards_cover_all_rows_once(spark):
    for n, world in ((10, 3), (2, 4), (9, 3)):
        rows = shard.numbered(spark.range(n), "id")
        got = rows.select(*(f(F.col("position"), F.col("n"), world).alias(k) for k, f in (("b", shard.balanced), ("c", shard.ceil_chunk), ("f", shard.floor_slice))), "id").orderBy("id").collect()
        assert [r.b for r in got] == sorted(r.b for r in got) and max(r.b for r in got) < world
        sizes = [sum(r.b == s for r in got) for s in range(world)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
        assert sum(r.f is None for r in got) == (n % world if n >= world else n)


def test_fixed_sizes_and_rotation(spark):
    rows = shard.numbered(spark.range(1, 6), "id")
    assert [tuple(r) for r in rows.select("id", shard.round_robin(F.col("position"), 2), shard.fixed_size(F.col("position"), 2)).orderBy("id").collect()] == [(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1), (5, 0, 2)]
    assert [r.id for r in rows.orderBy(shard.rotated(F.col("position"), F.col("n"), 3)).collect()] == [4, 5, 1, 2, 3]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_many_rows_with_payload(spark, adaptive):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        rows = spark.range(n).select((F.col("id") % 1000).alias("k"), F.lit("the same").alias("c"), F.md5(F.col("id").cast("string")).alias("payload"))
        placed = shard.numbered(rows, F.col("k").desc())
        assert placed.columns == ["k", "c", "payload", "position", "n"]
        assert tuple(placed.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position"), F.min("n"), F.max("n"), F.count_distinct("payload")).first()) == (n, n, 0, n - 1, n, n, n)
        assert placed.where("position < 1000 * (999 - k) OR position >= 1000 * (1000 - k)").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_numbers_of_odd_rows(spark):
    rows = spark.sql("SELECT * FROM VALUES (NULL, map('a', 1)), (NULL, NULL), (1, map('b', 2)), (1, map('b', 2)), (1, map('b', 2)) AS t(x, m)")
    got = shard.numbered(rows, "x").orderBy("position").collect()
    assert [r.position for r in got] == [0, 1, 2, 3, 4] and [r.x for r in got] == [None, None, 1, 1, 1]
    assert shard.numbered(rows.limit(0), "x").count() == 0
    with pytest.raises(ValueError):
        shard.numbered(spark.range(3).withColumnRenamed("id", "n"), "n")


def test_few_rows_for_many_workers(spark):
    rows = shard.numbered(spark.range(2), "id")
    s = lambda **k: sorted(tuple(r.s) for r in rows.select(shard.two_level(F.col("position"), F.col("n"), 2, 2, **k).alias("s")).collect())
    assert s(allow_empty=True) == [(0, 0), (0, 1)]
    assert rows.select(shard.two_level(F.col("position"), F.col("n"), 2, 2).alias("s")).where("s.rank IS NULL").count() == 2
    with pytest.raises(Exception, match="fewer rows"):
        s(force=True)


def test_repeat_and_mixture(spark):
    assert [r.place for r in shard.repeated_to(spark.range(3), 7, "id").orderBy("place").collect()] == list(range(7))
    draws = spark.range(20000).select(mix.group_of([1.0, 3.0], 1, "id").alias("g")).groupBy("g").count().collect()
    assert abs({r.g: r["count"] for r in draws}[1] / 20000 - 0.75) < 0.02


def test_uniform_is_stable(spark):
    u = one(spark, det.uniform(1, "x", "id"))
    assert 0 <= u < 1 and u == one(spark, det.uniform(1, "x", F.lit(0)))


def test_resize(spark):
    s = lambda w, h, **k: tuple(one(spark, geometry.resize_dims(F.lit(w), F.lit(h), 1024, 256, 16, 10**9, **k)))
    assert s(512, 512) == (512, 512)
    assert s(4096, 1024) == (1024, 256)
    assert s(100, 50) == (512, 256)


def test_boxes(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, geometry.iou(box(0, 0, 9, 9), box(0, 0, 9, 9))) == 1.0
    assert one(spark, geometry.iou(box(0, 0, 9, 9), box(10, 0, 19, 9))) == 0.0
    a, b = box(0, 0, 9, 9), box(5, 0, 14, 9)
    assert one(spark, geometry.iou(a, b)) == one(spark, geometry.iou(b, a)) == pytest.approx(50 / 150)
    assert one(spark, geometry.relative_position(box(0, 0, 10, 10), box(100, 0, 110, 10))) == ["left of"]
    assert one(spark, geometry.relative_position(box(0, 0, 10, 10), box(1, 0, 11, 10))) == []
    boxes = F.array(box(0, 0, 9, 9, 0.5), box(0, 0, 9, 8, 0.9), box(50, 50, 60, 60, 0.7), box(0, 0, 1, 1, 0.1))
    assert [b[4] for b in one(spark, geometry.suppressed(geometry.top_boxes(boxes, 0.3), 0.5))] == [0.9, 0.7]


def test_frames(spark):
    assert one(spark, frames.interval_frames(F.lit(10), 4)) == [0, 3, 5, 8]
    assert one(spark, frames.interval_frames(F.lit(2), 4)) == [0, 1, 1, 1]
    assert one(spark, frames.clip_frames(F.lit(10), 16, 4, 10, F.lit(0.0))) is None
    r = one(spark, frames.adaptive(F.lit(9), [5, 10], [1], F.lit(0.0), F.lit(0.0), "center"))
    assert (r.length, r.start) == (5, 2)
    s = [frames.Strategy(2, (4, 5), 0.0), frames.Strategy(3, (1, 3, 5), 1.0)]
    lengths = {one(spark, frames.advanced(F.lit(10), s, F.lit(0.5), F.lit(u), F.lit(0.0))).length for u in (0.1, 0.5, 0.9)}
    assert lengths == {1, 3}
    assert one(spark, frames.keyframe_of(F.lit(7), F.array(F.lit(0), F.lit(5), F.lit(9)))) == 1
    assert [tuple(x) for x in one(spark, frames.keyframe_plan(F.array(F.lit(9), F.lit(1)), F.array(F.lit(0), F.lit(5))))] == [(1, 0, True, 1), (9, 1, True, 0)]
    assert one(spark, frames.edit_pair(F.lit(2), F.array(F.array(F.lit("do"))), *(F.lit(0.0),) * 4)).texts == ["do"]


@pytest.mark.parametrize(
    ("raw", "clean_text"),
    [
        ("A%20cat+sits <br> here", "a cat sits here"),
        ("see https://x.com/page now", "see now"),
        ("ip 10.0.0.1 end", "ip end"),
        ("<p>Caf&eacute; &amp; bar</p>", "café bar"),
        ("a_b_c_d_e", "a b c d e"),
        ("pic.jpg of 中文 dog", "of dog"),
        ("6640x480 photo", "photo"),
        ("", ""),
        (None, None),
    ],
)
def test_cleaner(spark, raw, clean_text):
    got = spark.createDataFrame([(raw,)], "t string").select(clean.clean_caption(F.col("t"))).first()[0]
    assert got == clean_text


def test_answers(spark):
    s = lambda f, *v: one(spark, f(*(F.lit(x) for x in v)))
    assert [s(answers.yes_no, x) for x in ("Yes", "no.", "maybe yes")] == ["yes", "no", "other"]
    assert s(text.normal_answer, "The two, cats!") == "2 cats"
    assert s(text.normal_answer, "isnt it") == "isn't it"
    assert s(answers.relaxed_correct, "100", "104") and not s(answers.relaxed_correct, "100", "106")
    assert s(answers.relaxed_correct, "0", "0") and not s(answers.relaxed_correct, "0", "0.0")
    assert s(answers.relaxed_correct, "5%", "0.05")
    golds = F.array(*(F.lit("a"),) * 4, *(F.lit("b"),) * 6)
    assert one(spark, answers.soft_accuracy(F.lit("a"), golds)) == pytest.approx(1.0)
    assert one(spark, answers.anls(F.lit(""), F.array(F.lit("")))) == 1.0
    assert one(spark, answers.numbers_in(F.lit("1,234 and 2e3 or 7"))) == ["1,234", "2e3", "234", "3", "7"]
    assert one(spark, answers.parsed_open(F.lit("The answer is 5"))) == ["5.0"]
    assert one(spark, answers.open_correct(F.array(F.lit("5")), answers.parsed_open(F.lit("so it is 5."))))
    assert one(spark, answers.parsed_choice(F.lit("(A) no, (B)"), F.array(F.lit("x"), F.lit("y")))) == "B"
    assert s(answers.is_digit_string, "3.000") and not s(answers.is_digit_string, "3.1")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=10, max_size=10), st.sampled_from("abcd"))
def test_soft_accuracy_is_leave_one_out(spark, golds, pred):
    want = sum(min(1, sum(g == pred for j, g in enumerate(golds) if j != i) / 3) for i in range(10)) / 10 if pred in golds else 0.0
    assert one(spark, answers.soft_accuracy(F.lit(pred), F.array(*map(F.lit, golds)))) == pytest.approx(want)


def test_chat(spark):
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), F.lit(what).alias("value"))
    turns = F.array(turn("human", "<image> what?"), turn("gpt", "a cat"), turn("system", "x"))
    e = one(spark, plan.chat_elements(turns, F.lit(1)))
    assert [(x.type, x.has_loss, x.text) for x in e] == [("image", None, None), ("text", 0, "what?"), ("text", 1, "a cat")]
    assert one(spark, plan.has_loss(plan.chat_plan(plan.chat_elements(turns, F.lit(1)))))
    assert one(spark, plan.video_turns(F.array(turn("human", "hi"), turn("human", "<video>")), F.lit(2))) is None
    assert one(spark, plan.video_turns(F.array(turn("human", "<video>?")), F.lit(2)))[0].value == "<image><image>?"


def test_spans_and_masks(spark):
    items = spark.createDataFrame([(1, 0, "text", 3, 0, 1, None), (1, 1, "vae_image", 4, 0, 1, None), (1, 2, "vit_image", 2, 0, 0, None), (1, 3, "vae_video", 8, 2, 0, None)], "s int, place int, type string, n long, frames long, loss int, frame_delta int")
    got = spans.spans(items, "s").orderBy("place").collect()
    assert [(r.start, r.end, r["rope"], r["mode"]) for r in got] == [(0, 5, 0, "causal"), (5, 11, 5, "noise"), (11, 15, 5, "full"), (15, 25, 6, "full")]
    assert (got[0].ce_start, got[0].ce_end, got[1].mse_start, got[1].mse_end) == (0, 4, 6, 10)
    mask = one(spark, spans.dense_mask(F.array(F.lit(2), F.lit(1), F.lit(1)), F.array(F.lit("causal"), F.lit("noise"), F.lit("full"))))
    seen = [[x == 0.0 for x in row] for row in mask]
    assert seen == [[True, False, False, False], [True, True, False, False], [True, True, True, False], [True, True, False, True]]
    pairs = spans.span_mask(spans.spans(items, "s"), ["s"]).agg(F.sum("pairs")).first()[0]
    assert pairs == 15 + 36 + 30 + 16 + 20 + 100 + 50 + 40
    r = one(spark, spans.inference_index(F.array(F.lit(2).cast("long"), F.lit(0).cast("long")), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    assert (r.query, r.cached) == ([2, 3, 4], [0, 1])


def test_inference_index_of_many_sequences(spark):
    n = 40_000
    lens, new = [i % 7 for i in range(n)], [i % 3 + 1 for i in range(n)]
    query, cached, at = [], [], 0
    for a, b in zip(lens, new, strict=True):
        cached += range(at, at + a)
        query += range(at + a, at + a + b)
        at += a + b
    rows = spark.range(n).select(F.lit("x").alias("k"), "id", (F.col("id") % 7).alias("l"), (F.col("id") % 3 + 1).alias("b"))
    began = time.monotonic()
    got = records.collated(rows, ["k"], "id", "l", "b").select(spans.inference_index(F.col("l"), F.col("b")).alias("i")).first().i
    assert (got.query, got.cached) == (query, cached) and time.monotonic() - began < 40  # a sum over all before each took minutes
    placed = spans.inference_places(rows, ["k"], "id", "l", "b").orderBy("id").collect()
    assert [x for r in placed for x in r.query] == query and [x for r in placed for x in r.cached] == cached
    none = F.array().cast("array<bigint>")
    assert tuple(one(spark, spans.inference_index(none, none))) == ([], [])


def test_metrics_without_positives(spark):
    a = spark.createDataFrame([("no", "other"), ("no", "no")], "gold string, pred string")
    r = metrics.confusion(a, "gold", "pred").first()
    assert (r.precision, r.recall, r.f1, r.acc, r.other) == (0.0, 0.0, 0.0, 0.5, 1)
    p = spark.createDataFrame([(1, True), (2, True), (3, True)], "id int, ok boolean")
    assert tuple(metrics.global_pair_accuracy(p, ["id"], "ok").first()) == (1, 1.0)
    same = spark.createDataFrame([("a b c d e", "a b c d e")], "p string, g string")
    assert metrics.bleu(same, "p", "g").first().bleu4 == pytest.approx(1.0)


def test_rules(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    objects = F.create_map(F.lit("cat"), F.array(box(0, 0, 10, 10)), F.lit("dog"), F.array(box(100, 0, 110, 10)))
    rule = lambda c, n, pos=None, at=None: F.struct(F.lit(c).alias("class"), F.lit(n).alias("count"), F.lit(pos).cast("string").alias("position"), F.lit(at).cast("int").alias("target"))
    none = F.array().cast("array<struct<class:string,count:int>>")
    assert one(spark, metrics.rule_verdict(objects, F.array(rule("cat", 1), rule("dog", 1, "right of", 0)), none)).correct
    bad = one(spark, metrics.rule_verdict(objects, F.array(rule("cat", 2)), F.array(F.struct(F.lit("dog").alias("class"), F.lit(1).alias("count")))))
    assert not bad.correct and len(bad.reasons) == 2


def test_breaker_and_integrity(spark):
    rows = spark.createDataFrame([("f", i, b) for i, b in enumerate([False, True, True, False, True, True, True, False])], "file string, i int, bad boolean")
    assert [r.i for r in records.until_breaker(rows, "file", ["i"], "bad", 2).orderBy("i").collect()] == [0, 3]
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    kv = spark.createDataFrame([("a", '{"x": "1"}'), ("b", "{bad"), ("d", "{}")], "key string, value string")
    r = records.kv_integrity(keys, kv, "x string").first()
    assert (r.expected, r.stored, r.missing, r.unexpected, r.broken, r.ok) == (3, 3, 1, 1, 1, False)


def test_alignment_and_strictness(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "k")], "id int, t string, u string")
    b = spark.createDataFrame([(1, "z"), (2, None)], "id int, t string")
    assert [tuple(r) for r in records.aligned(a, b, key="id").select("id", "t", "u").orderBy("id").collect()] == [(1, "z", None), (2, "y", "k")]
    with pytest.raises(Exception, match="no gold row"):
        records.with_gold(a, b.where("id = 1").withColumnRenamed("t", "g"), ["id"], strict=True).collect()


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (320).to_bytes(2, "little") + (200).to_bytes(2, "little")
    rows = spark.createDataFrame([(png,), (gif,), (b"\xff\xd8\xff\xe0",), (b"none",)], "b binary")
    got = rows.select(records.image_kind(F.col("b")), records.image_size(F.col("b"))).collect()
    assert [(r[0], tuple(r[1]) if r[1] else None) for r in got] == [("png", (640, 480)), ("gif", (320, 200)), ("jpeg", None), (None, None)]


def test_catalog(spark):
    rows = catalog.catalog(spark, {"a": {"dataset_names": ["x", "y"], "weight": 4.0, "num_used_data": [1, 2]}, "b": {"dataset_names": ["z"], "is_mandatory": True}})
    assert rows.count() == 3 and rows.where("is_mandatory").first().dataset_name == "z"
    for bad in ({"a": {"dataset_names": ["x"], "wrong": 1}}, {"a": {"dataset_names": ["x"], "kind": "?"}}, {"a": {"dataset_names": ["x"], "weight": 0.0}}):
        with pytest.raises(ValueError):
            catalog.groups_of(bad)
    catalog.register_function("first", lambda c: F.get(c, 0))
    assert one(spark, catalog.function("first", F.array(F.lit(5)))) == 5


def test_json_and_tar_and_sinks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps([{"path": "p", "cap": "c"}, {"path": "q", "cap": ["d", "e"]}]))
    (tmp_path / "j" / "b_key.json").write_text("[]")
    rows = readers.good_records(readers.json_files(spark, str(tmp_path / "j" / "a.json"), readers.TEXT_IMAGE))
    assert sorted(tuple(r[0]) for r in rows.select(records.as_captions(F.col("cap"))).collect()) == [("c",), ("d", "e")]
    assert readers.json_listing(spark, str(tmp_path / "j"), "_key.json").count() == 1
    assert readers.record_files(spark, str(tmp_path / "j")).count() == 2
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, data in (("x/1.jpg", b"img"), ("x/1.txt", b"hi"), ("x/2.jpg", b"alone")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "ok.tar").write_bytes(buf.getvalue())
    (tmp_path / "t" / "bad.tar").write_bytes(b"no archive at all")
    members = readers.tar_members(spark, str(tmp_path / "t"))
    assert [(r.stem, r.text) for r in readers.tar_pairs(members).collect()] == [("x/1", "hi")]
    assert tuple(readers.tar_report(members).first()) == (2, 1, 3)
    docs = spark.createDataFrame([("d/f.json", 0, "a"), ("d/f.json", 1, "b")], "path string, i int, v string")
    sinks.key_values(docs, str(tmp_path / "kv"), "path", "i")
    assert [r.key for r in spark.read.parquet(str(tmp_path / "kv" / "keys")).collect()] == ["d/f_0", "d/f_1"]
    sinks.in_source_order(spark.range(10), spark.range(10).withColumn("p", 9 - F.col("id")), "id", "p", str(tmp_path / "o"), 2, 3)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10
    assert readers.row_groups(spark, str(tmp_path / "o")).agg(F.sum("rows")).first()[0] == 10
    sinks.json_once(docs, str(tmp_path / "once"))
    sinks.json_once(docs.union(docs), str(tmp_path / "once"))
    assert spark.read.json(str(tmp_path / "once")).count() == 2


def test_file_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.range(4).write.parquet(src)
    resume.run_available(resume.file_stream(spark, src, "id long"), out, cp)
    spark.range(4, 10).write.mode("append").parquet(src)
    resume.run_available(resume.file_stream(spark, src, "id long"), out, cp)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_packed_stream_carries_its_open_sequence(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "shard string, id long, n long"
    for batch in ([("s", 1, 6), ("s", 2, 3)], [("s", 3, 4), ("s", 4, 99), ("s", 5, 7)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        resume.run_available(carry.packed_stream(resume.file_stream(spark, src, schema), 10, 10), out, cp)
    got = sorted((r.bin, r.place, r.id) for r in spark.read.parquet(out).collect())
    assert got == [(0, 0, 1), (0, 1, 2), (1, 0, 3)]


def test_tables_of_the_shared_folder(spark):
    import os
    from types import SimpleNamespace

    from spindle import durable

    rows = durable.stored(spark.range(50).repartition(40), "test", 50)
    path = durable._PATHS[rows]
    assert rows.count() == 50 and len(rows.inputFiles()) <= durable.FILES
    durable.released(rows, spark.range(1))
    assert path not in durable._LEFT and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            durable.shared_dir(unset(master))
    assert durable.shared_dir(unset("local[2]")) == durable.shared_dir(unset("local[2]")) and durable.shared_dir(unset("local[2]")).startswith("file:///")


def test_stored_tables_have_data_files_alone(spark):
    import os
    import re

    from spindle import durable

    for rows in (spark.range(50).repartition(3), spark.range(0)):
        table = durable.stored(rows, "test")
        names = os.listdir(durable._PATHS[table].removeprefix("file://"))
        assert names and all(re.fullmatch(r"part-.*\.parquet", n) for n in names), names
        assert table.count() == rows.count()
        durable.released(table)


def test_bpe(spark):
    vocabulary, merges = tokens.learned_merges({"low": 5, "lower": 2}, 3)
    bpe = tokens.Bpe(vocabulary, merges)
    assert bpe.parts("low") == ["low"] and bpe.decode(bpe.encode(["low", " é"])) == "low é"
    rows = spark.createDataFrame([("low low",), (None,)], "t string")
    got = [r.ids for r in tokens.encoded(rows, "t", bpe).collect()]
    assert got[1] is None and bpe.decode(got[0]) == "low low"
    assert one(spark, tokens.with_eos(F.array(F.lit(1)), 2)) == [1, 2] and one(spark, tokens.with_eos(F.array(F.lit(2)), 2)) == [2]


def test_suite(spark):
    s = prompts.suite(spark, ["person", "cat", "apple"], 30, 1).collect()
    assert sum(r.tag == "single_object" for r in s) == 3
    assert all(x["class"] != "person" for r in s if r.tag in ("colors", "color_attr") for x in r.include)
    assert all(r.include[0]["class"] != r.include[1]["class"] for r in s if r.tag in ("two_object", "position", "color_attr"))
    assert len({r.prompt + str(r.include) for r in s}) == len(s)


def test_key_value_records(spark):
    import struct

    text = lambda s: struct.pack("<i", len(s.encode()) + 1) + s.encode() + b"\0"
    inner = b"\x100\0" + struct.pack("<i", 7) + b"\x081\0\x01"
    inner = struct.pack("<i", len(inner) + 5) + inner + b"\0"
    body = b"\x02a\0" + text("é") + b"\x01b\0" + struct.pack("<d", 0.5) + b"\x04c\0" + inner + b"\x0ad\0" + b"\x05e\0" + struct.pack("<i", 2) + b"\0xy"
    bson = struct.pack("<i", len(body) + 5) + body + b"\0"
    assert readers.bson_to_plain(bson) == {"a": "é", "b": 0.5, "c": [7, True], "d": None, "e": "eHk="}
    rows = spark.createDataFrame([(1, bson), (2, b'{"k": 1}'), (3, b"neither"), (4, None)], "id int, v binary")
    got = {r.id: r.record for r in readers.decoded_records(rows, "v").collect()}
    assert json.loads(got[1])["c"] == [7, True] and json.loads(got[2]) == {"k": 1} and got[3] is None and got[4] is None


def test_config_file(spark, tmp_path):
    path = tmp_path / "mix.json"
    path.write_text(json.dumps({"a": {"dataset_names": ["x"]}}))
    assert catalog.catalog(spark, catalog.load_config(str(path))).count() == 1


def test_parts_sum_up(spark):
    for total in (1, 2, 30):
        parts = one(spark, frames.integer_parts(F.lit(total), 1, F.lit(5), 0.9))
        assert sum(parts) == total and all(p > 0 for p in parts)


def test_positions_of_more_than_a_thousand_files_of_a_task(spark, tmp_path):
    rows = spark.range(1100)
    sinks.in_source_order(rows, rows.select("id", (1099 - F.col("id")).alias("position")), "id", "position", str(tmp_path / "f"), 1, 1)
    got = readers.source_positions(readers.row_positions(spark, str(tmp_path / "f"), "id")).collect()
    assert len(got) == 1100 and all(r.position == 1099 - r.id for r in got)  # by name, file 1000 comes before file 999


def often(spark, column, what):
    """How often a part stands in a column's optimised plan: as often as it is worked out, or more."""
    rows = spark.range(3).select((F.col("id") * 20).cast("int").alias("n"), "id", F.col("id").cast("string").alias("t"))
    return rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_frame_choice_draws_once(spark):
    u = det.uniform(6, "stride", "id")
    assert often(spark, frames.adaptive(F.col("n"), [9, 17, 33], [1, 2, 4], u, F.lit(0.0), "center"), "md5(") == 1
    assert often(spark, frames.advanced(F.col("n"), [frames.Strategy(1, (4, 8)), frames.Strategy(3, (4, 8))], u, det.uniform(6, "length", "id"), F.lit(0.0)), "md5(") == 2


def test_integer_parts_cuts_once(spark):
    for decay in (1.0, 0.9):
        assert often(spark, frames.integer_parts(F.col("n"), 5, F.col("id"), decay), "md5(") == 2  # the number of parts, and the cuts


def test_normal_answer_reads_its_text_once(spark):
    assert often(spark, text.normal_answer(F.col("t")), "lower(") == 1


@pytest.fixture
def wide_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    was = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("10000", "64m"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, was, strict=True):
        spark.conf.set(k, v)


def batch_rows(pieces):
    """Rows that a worker gets at a time."""
    from pyspark.sql.pandas.functions import pandas_udf

    return pandas_udf(lambda s: s * 0 + len(s), "long")(pieces)


def test_batches_of_bpe_are_bounded(spark, wide_batches):
    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("ab "), 10).alias("t"))
    coded = tokens.encoded(rows, "t", tokens.Bpe({"a": 0, "b": 1}, []))
    assert coded.select(batch_rows(F.col("id")).alias("n")).agg(F.max("n")).first()[0] <= 1000


def test_batches_of_the_caption_cleaner_are_bounded(spark, wide_batches):
    rows = spark.range(0, 4000, 1, 1).select("id", clean.clean_caption(F.concat(F.lit("<b>x</b> "), F.col("id").cast("string"))).alias("t"))
    assert rows.select(batch_rows(F.length("t")).alias("n")).agg(F.max("n")).first()[0] <= 1000
