"""Benchmark metrics and answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import answers
from spindle.operators import metrics
from spindle.queries.registry import Tables, query


def _judged(t: Tables) -> DataFrame:
    """Labelled documents: gold from quality, prediction from toxic, correct where they agree."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    pred = F.when(F.pmod("doc_id", F.lit(17)) == 0, "other").otherwise(yes(F.col("toxic") == 0))
    return t.labels.join(t.documents.drop("text"), "doc_id").select("doc_id", "lang", "source", yes(F.col("quality") == 1).alias("gold"), pred.alias("pred")).withColumn("correct", F.col("gold") == F.col("pred"))


_JUDGED = """
WITH j AS (
  SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS gold, CASE WHEN doc_id % 17 = 0 THEN 'other' WHEN toxic = 0 THEN 'yes' ELSE 'no' END AS pred
  FROM labels JOIN documents USING (doc_id)
), c AS (SELECT *, gold = pred AS correct FROM j)
"""


@query(_JUDGED + """, p AS (SELECT source, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS good FROM c GROUP BY source)
SELECT CAST(sum(n) AS BIGINT) AS images, CAST(count(*) AS BIGINT) AS prompts, round(sum(good) / sum(n), 9) AS image_acc, round(sum(CASE WHEN good > 0 THEN 1 ELSE 0 END) / count(*), 9) AS prompt_acc FROM p""")
def q_geneval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.prompt_summary(_judged(Tables(spark, sf_dir)), "source", "correct")
    return s.withColumns({c: F.round(c, 9) for c in ("image_acc", "prompt_acc")})


@query(_JUDGED + """, t AS (SELECT lang, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n, min(doc_id) AS f FROM c GROUP BY lang)
SELECT lang, round(acc, 9) AS acc, CAST(n AS BIGINT) AS n, round(avg(acc) OVER (), 9) AS macro, CAST(row_number() OVER (ORDER BY f) AS BIGINT) AS rank FROM t""")
def q_geneval_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.tag_scores(_judged(Tables(spark, sf_dir)), "lang", "correct", "doc_id")
    return s.select("lang", F.round("acc", 9).alias("acc"), "n", F.round("macro", 9).alias("macro"), F.col("rank").cast("long").alias("rank"))


_WISE = """
WITH s AS (
  SELECT o_orderkey, o_orderpriority AS file, o_orderkey % 3 AS consistency, o_custkey % 3 AS realism, CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 97 = 0 THEN 9.9 ELSE CAST(o_custkey % 2 AS DOUBLE) END AS aesthetic_quality, o_orderkey % 400 + 650 AS prompt_id
  FROM orders
), v AS (SELECT *, max(CASE WHEN consistency = 9.9 OR realism = 9.9 OR aesthetic_quality = 9.9 THEN 1 ELSE 0 END) OVER (PARTITION BY file) AS bad, count(*) OVER (PARTITION BY file) AS n FROM s),
w AS (SELECT *, CASE WHEN prompt_id BETWEEN 701 AND 800 THEN 'Biology' WHEN prompt_id BETWEEN 801 AND 900 THEN 'Physics' WHEN prompt_id BETWEEN 901 AND 1000 THEN 'Chemistry' ELSE '?' END AS category, 0.7::DOUBLE * consistency + 0.2::DOUBLE * realism + 0.1::DOUBLE * aesthetic_quality AS x FROM v WHERE bad = 0 AND n >= 300),
a AS (SELECT category, sum(x) AS total, sum(x) / (2 * count(*)) AS average FROM w GROUP BY category)
"""


def _wise(t: Tables) -> DataFrame:
    aesthetic = F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 97 == 0), 9.9).otherwise((F.col("o_custkey") % 2).cast("double"))
    s = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("file"), (F.col("o_orderkey") % 3).cast("double").alias("consistency"), (F.col("o_custkey") % 3).cast("double").alias("realism"), aesthetic.alias("aesthetic_quality"), (F.col("o_orderkey") % 400 + 650).alias("prompt_id"))
    return metrics.judge_average(s, metrics.science_of(F.col("prompt_id")), "file", 300)


@query(_WISE + "SELECT category, round(total, 5) AS total, round(average, 9) AS average FROM a")
def q_wise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wise(Tables(spark, sf_dir)).select("category", F.round("total", 5).alias("total"), F.round("average", 9).alias("average"))


@query(_WISE + "SELECT round(avg(average), 9) AS overall FROM a")
def q_wise_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overall(_wise(Tables(spark, sf_dir))).select(F.round("overall", 9).alias("overall"))


@query("""WITH a AS (SELECT event_type AS task, event_id, value > 50 AS correct, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 2 AS pair FROM events),
p AS (SELECT task, pair, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS good FROM a GROUP BY task, pair HAVING count(*) = 2)
SELECT task, round(sum(good) / sum(n), 9) AS acc, round(sum(CASE WHEN good = 2 THEN 1 ELSE 0 END) / count(*), 9) AS acc_plus, CAST(count(*) AS BIGINT) AS pairs, round(100 * (sum(good) / sum(n) + sum(CASE WHEN good = 2 THEN 1 ELSE 0 END) / count(*)), 7) AS score FROM p GROUP BY task""")
def q_mme_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tables(spark, sf_dir).events.select(F.col("event_type").alias("task"), "event_id", (F.col("value") > 50).alias("correct"))
    s = metrics.pair_scores(a, "task", ["event_id"], "correct")
    return s.select("task", F.round("acc", 9).alias("acc"), F.round("acc_plus", 9).alias("acc_plus"), "pairs", F.round("score", 7).alias("score"))


@query("""WITH a AS (SELECT value > 50 AS correct, (row_number() OVER (ORDER BY event_id) - 1) // 2 AS pair FROM events), p AS (SELECT pair, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS good FROM a GROUP BY pair HAVING count(*) = 2)
SELECT CAST(count(*) AS BIGINT) AS pairs, round(sum(CASE WHEN good = 2 THEN 1 ELSE 0 END) / count(*), 9) AS acc FROM p""")
def q_mmvp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tables(spark, sf_dir).events.select("event_id", (F.col("value") > 50).alias("correct"))
    return metrics.global_pair_accuracy(a, ["event_id"], "correct").select("pairs", F.round("acc", 9).alias("acc"))


_CONF = _JUDGED + """, k AS (
  SELECT lang, sum(CASE WHEN gold = 'yes' AND pred = 'yes' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN gold = 'no' AND pred = 'yes' THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN gold = 'no' AND pred = 'no' THEN 1 ELSE 0 END) AS tn,
    sum(CASE WHEN gold = 'yes' AND pred = 'no' THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN pred = 'other' THEN 1 ELSE 0 END) AS other, count(*) AS n, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS good FROM c GROUP BY lang
), s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM k),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s)
"""


@query(_CONF + "SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(other AS BIGINT) AS other, CAST(n AS BIGINT) AS n, round(good / n, 9) AS acc, round(p, 9) AS precision, round(r, 9) AS recall, round((tp + fp) / n, 9) AS yes_ratio, round(f1, 9) AS f1 FROM f")
def q_pope_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.confusion(_judged(Tables(spark, sf_dir)), "gold", "pred", "lang")
    return s.withColumns({c: F.round(c, 9) for c in ("acc", "precision", "recall", "yes_ratio", "f1")})


@query(_CONF + "SELECT round(avg(f1), 9) AS macro_f1 FROM f")
def q_pope_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(metrics.confusion(_judged(Tables(spark, sf_dir)), "gold", "pred", "lang")).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("""SELECT r_name AS domain, n_name AS category, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 9) AS acc, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def q_mmmu_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("category"), F.col("r_name").alias("domain"))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("correct", F.col("o_orderstatus") == "F")
    return metrics.rolled_up(o, "domain", "category", "correct").select("domain", "category", "n", F.round("acc", 9).alias("acc"), F.col("level").cast("long").alias("level"))


@query(_JUDGED + """, kv AS (SELECT 'lang' AS key, lang AS value, correct FROM c UNION ALL SELECT 'source', source, correct FROM c UNION ALL SELECT 'skills', unnest(['len' || CAST(doc_id % 3 AS VARCHAR), 'mod' || CAST(doc_id % 2 AS VARCHAR)]), correct FROM c)
SELECT key, value, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(count(*) AS BIGINT) AS n, printf('%.2f', sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*) * 100) AS acc FROM kv GROUP BY key, value""")
def q_multi_key_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = F.array(F.concat(F.lit("len"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("mod"), (F.col("doc_id") % 2).cast("string")))
    return metrics.by_many_keys(_judged(Tables(spark, sf_dir)).withColumn("skills", skills), ["lang", "source"], ["skills"], "correct")


@query(_JUDGED + """, a AS (SELECT lang, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) * 100, 2) AS acc FROM c GROUP BY lang)
SELECT lang, acc, round(acc - 50.0, 2) AS gain FROM a""")
def q_score_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _judged(Tables(spark, sf_dir)).groupBy("lang").agg(F.round(F.avg(F.col("correct").cast("double")) * 100, 2).alias("acc"))
    return metrics.against_baseline(s, s.select("lang", F.lit(50.0).alias("acc")), ["lang"], "acc")


# --- scores of single answers ------------------------------------------------------------


def _ten(t: Tables) -> tuple[DataFrame, Column, Column]:
    """Ten gold answers for each item: its first word for as many as its id leaves modulo 7, else another."""
    golds = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.when(i <= F.col("item_id") % 7, "cat").otherwise(F.concat(F.lit("dog"), (i % 3).cast("string"))))
    return t.benchmark, F.when(F.col("item_id") % 2 == 0, "cat").otherwise("dog1"), golds


_TEN = "WITH b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'cat' ELSE 'dog1' END AS pred, list_transform(range(1, 11), lambda i: CASE WHEN i <= item_id % 7 THEN 'cat' ELSE 'dog' || CAST(i % 3 AS VARCHAR) END) AS golds FROM benchmark)"


@query(_TEN + ", k AS (SELECT item_id, len(list_filter(golds, lambda g: g = pred)) AS k FROM b) SELECT item_id, round(CASE WHEN k > 0 THEN (k * least(1.0, (k - 1) / 3) + (10 - k) * least(1.0, k / 3)) / 10 ELSE 0 END, 9) AS acc, k > 0 AS any_match FROM k")
def q_vqa_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, pred, golds = _ten(Tables(spark, sf_dir))
    return b.select("item_id", F.round(answers.soft_accuracy(pred, golds), 9).alias("acc"), answers.exact_match(pred, golds).alias("any_match"))


_CUT = "substr(p_name, 1, greatest(1, length(p_name) - p_size % 6))"


@query(f"""WITH a AS (SELECT p_partkey, p_name, lower(trim({_CUT})) AS pred, lower(p_name) AS gold FROM part),
s AS (SELECT *, 1 - levenshtein(pred, gold) / greatest(length(pred), length(gold)) AS x, 1 - levenshtein(pred, lower(p_name || ' x')) / greatest(length(pred), length(p_name) + 2) AS y FROM a)
SELECT p_partkey, round(greatest(CASE WHEN x < 0.5 THEN 0 ELSE x END, CASE WHEN y < 0.5 THEN 0 ELSE y END), 9) AS anls FROM s""")
def q_anls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.substring("p_name", F.lit(1), F.greatest(F.lit(1), F.length("p_name") - F.col("p_size") % 6))
    golds = F.array("p_name", F.concat("p_name", F.lit(" x")))
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(answers.anls(cut, golds), 9).alias("anls"))


_CHOICES = "[p_brand, p_type, p_name, 'none of these']"


@query(f"""WITH d AS (SELECT p_partkey, {_CHOICES} AS c, list_transform({_CHOICES}, lambda x: levenshtein(substr(p_type, 1, 6), x)) AS l FROM part)
SELECT p_partkey, c[list_position(l, list_min(l))] AS choice FROM d""")
def q_closest_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.array("p_brand", "p_type", "p_name", F.lit("none of these"))
    return Tables(spark, sf_dir).part.select("p_partkey", answers.closest_choice(F.substring("p_type", 1, 6), choices).alias("choice"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS gold, CAST(CAST(l_quantity + l_partkey % 5 - 2 AS BIGINT) AS VARCHAR) || CASE WHEN l_partkey % 7 = 0 THEN '%' ELSE '' END AS pred FROM lineitem),
f AS (SELECT *, CAST(gold AS DOUBLE) AS t, CASE WHEN ends_with(pred, '%') THEN CAST(rtrim(pred, '%') AS DOUBLE) / 100 ELSE CAST(pred AS DOUBLE) END AS p FROM v)
SELECT CAST(l_linenumber AS BIGINT) AS line, CAST(sum(CASE WHEN t <> 0 AND abs(p - t) / abs(t) <= 0.05 OR t = 0 AND pred = gold THEN 1 ELSE 0 END) AS BIGINT) AS by_gold,
  CAST(sum(CASE WHEN p <> 0 AND abs(t - p) / abs(p) <= 0.05 OR p = 0 AND pred = gold THEN 1 ELSE 0 END) AS BIGINT) AS by_answer FROM f GROUP BY 1""")
def q_relaxed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.col("l_quantity").cast("long").cast("string")
    pred = F.concat((F.col("l_quantity") + F.col("l_partkey") % 5 - 2).cast("long").cast("string"), F.when(F.col("l_partkey") % 7 == 0, "%").otherwise(""))
    v = Tables(spark, sf_dir).lineitem.select(F.col("l_linenumber").cast("long").alias("line"), gold.alias("gold"), pred.alias("pred"))
    n = lambda a, b: F.sum(answers.relaxed_correct(F.col(a), F.col(b)).cast("long"))
    return v.groupBy("line").agg(n("gold", "pred").alias("by_gold"), n("pred", "gold").alias("by_answer"))


@query("SELECT conv_id, turn, lower(trim(role)) IN ('user', 'assistant') AS correct FROM conversations")
def q_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", answers.exact_match(F.concat(F.lit(" "), "role"), F.array(F.lit("User "), F.lit("ASSISTANT"))).alias("correct"))


@query()
def q_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir).benchmark.select(F.regexp_replace("text", "\\.", " .").alias("gold"), F.regexp_replace("text", "[.,]", "").alias("pred"))
    return metrics.bleu(t, "pred", "gold")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS parts, round(sum(value), 4) AS loss_sum, CAST(sum(event_id % 100 + 1) AS BIGINT) AS tokens, round(sum(value) / sum(event_id % 100 + 1), 7) AS loss, round(8.0 / sum(event_id % 100 + 1), 9) AS scale FROM events GROUP BY user_id""")
def q_step_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("user_id", "value", (F.col("event_id") % 100 + 1).alias("n"))
    s = metrics.step_losses(e, "user_id", "value", "n", 8).join(e.groupBy("user_id").agg(F.count("*").alias("parts")), "user_id")
    return s.select("user_id", "parts", F.round("loss_sum", 4).alias("loss_sum"), "tokens", F.round("loss", 7).alias("loss"), F.round("scale", 9).alias("scale"))


@query("""SELECT event_id, round((event_id - lag(event_id) OVER w) / (epoch(ts) - lag(epoch(ts)) OVER w), 7) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def q_step_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return metrics.step_rate(e, "user_id", "event_id", "s").select("event_id", F.round("rate", 7).alias("rate"))


@query()
def q_rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda i: F.array(*(F.abs(F.col("embedding")[i + k]).cast("double") * 100 + (50 if k in (2, 3) else 0) for k in range(4)))
    objects = F.create_map(F.lit("cat"), F.array(box(0), box(4)), F.lit("dog"), F.when(F.col("label") % 2 == 0, F.array(box(8))).otherwise(F.slice(F.array(box(8)), 1, 0)))
    rule = lambda c, n, pos=None, at=None: F.struct(F.lit(c).alias("class"), F.lit(n).alias("count"), F.lit(pos).cast("string").alias("position"), F.lit(at).cast("int").alias("target"))
    v = metrics.rule_verdict(objects, F.array(rule("cat", 1), rule("dog", 1, "right of", 0)), F.array(F.struct(F.lit("cat").alias("class"), F.lit(3).alias("count"))))
    return Tables(spark, sf_dir).embeddings.select("vec_id", v["correct"].alias("correct"), F.array_join(v["reasons"], "; ").alias("reasons"))
