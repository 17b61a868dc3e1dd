"""Benchmark metrics as grouped aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.operators.shard import numbered


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def prompt_summary(results: DataFrame, prompt: str, correct: str) -> DataFrame:
    """One row: images, distinct prompts, the share of right images and of prompts with any right image."""
    per = results.groupBy(prompt).agg(F.count("*").alias("n"), _n(F.col(correct)).alias("good"))
    return per.agg(F.sum("n").alias("images"), F.count("*").alias("prompts"), _ratio(F.sum("good"), F.sum("n")).alias("image_acc"), _ratio(_n(F.col("good") > 0), F.count("*")).alias("prompt_acc"))


def tag_scores(results: DataFrame, tag: str, correct: str, order: str) -> DataFrame:
    """``(tag, acc, n, macro)`` in order of first appearance; macro: the plain mean over tags."""
    per = results.groupBy(tag).agg(F.avg(F.col(correct).cast("double")).alias("acc"), F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return per.withColumn("macro", F.avg("acc").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy("first_seen", tag)))


def judge_average(scores: DataFrame, category: Column, file: str, least: int) -> DataFrame:
    """Means of half of 0.7 consistency + 0.2 realism + 0.1 aesthetics by category; files with a missing score (9.9) or too few rows are left out."""
    parts = ("consistency", "realism", "aesthetic_quality")
    missing = reduce(lambda a, b: a | b, [F.col(p) == 9.9 for p in parts])
    w = Window.partitionBy(file)
    value = 0.7 * F.col("consistency") + 0.2 * F.col("realism") + 0.1 * F.col("aesthetic_quality")
    valid = scores.withColumn("category", category).withColumn("__bad", F.max(missing.cast("int")).over(w)).withColumn("__n", F.count("*").over(w)).where((F.col("__bad") == 0) & (F.col("__n") >= least))
    return valid.groupBy("category").agg(F.sum(value).alias("total"), (F.sum(value) / (2 * F.count("*"))).alias("average"))


def time_or_space(subcategory: Column) -> Column:
    return F.when(subcategory.isin("Longitudinal time", "Horizontal time"), "Time").otherwise("Space")


def science_of(prompt_id: Column) -> Column:
    return F.when(prompt_id.between(701, 800), "Biology").when(prompt_id.between(801, 900), "Physics").when(prompt_id.between(901, 1000), "Chemistry").otherwise("?")


def overall(averages: DataFrame) -> DataFrame:
    return averages.agg(F.avg("average").alias("overall"))


def pair_scores(answers: DataFrame, task: str, order: list[str], correct: str, drop_odd: bool = True) -> DataFrame:
    """Consecutive rows of a task are pairs: accuracy, share of pairs with both right, and 100 times their sum."""
    rn = F.row_number().over(Window.partitionBy(task).orderBy(*order)) - 1
    pairs = answers.withColumn("__pair", F.floor(rn / 2)).groupBy(task, "__pair").agg(F.count("*").alias("n"), _n(F.col(correct)).alias("good"))
    if drop_odd:
        pairs = pairs.where("n = 2")
    out = pairs.groupBy(task).agg(_ratio(F.sum("good"), F.sum("n")).alias("acc"), _ratio(_n(F.col("good") == 2), F.count("*")).alias("acc_plus"), F.count("*").alias("pairs"))
    return out.withColumn("score", 100 * (F.col("acc") + F.col("acc_plus")))


def global_pair_accuracy(answers: DataFrame, order: list[str], correct: str) -> DataFrame:
    """One row: the share of consecutive pairs with both right; an odd last row is left out."""
    placed = numbered(answers, *order).withColumn("__pair", F.floor(F.col("position") / 2))
    pairs = placed.groupBy("__pair").agg(F.count("*").alias("n"), _n(F.col(correct)).alias("good")).where("n = 2")
    return pairs.agg(F.count("*").alias("pairs"), _ratio(_n(F.col("good") == 2), F.count("*")).alias("acc"))


def confusion(answers: DataFrame, gold: str, pred: str, *by: str, yes: str = "yes", no: str = "no") -> DataFrame:
    """Counts and scores of yes/no answers by group; other answers count against accuracy, but in no precision or recall."""
    g, p = F.col(gold), F.col(pred)
    out = answers.groupBy(*by).agg(
        _n((g == yes) & (p == yes)).alias("tp"), _n((g == no) & (p == yes)).alias("fp"), _n((g == no) & (p == no)).alias("tn"), _n((g == yes) & (p == no)).alias("fn"),
        _n(~p.isin(yes, no)).alias("other"), F.count("*").alias("n"), _n(g == p).alias("good"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = out.withColumns({"acc": _ratio(F.col("good"), F.col("n")), "precision": precision, "recall": recall, "yes_ratio": _ratio(F.col("tp") + F.col("fp"), F.col("n"))})
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("good")


def macro(scores: DataFrame, value: str = "f1") -> DataFrame:
    return scores.agg(F.avg(value).alias(f"macro_{value}"))


def rolled_up(answers: DataFrame, domain: str, category: str, correct: str) -> DataFrame:
    """Accuracy of every category, domain and overall in one pass, weighted by rows; ``level`` 0, 1, 2."""
    return answers.rollup(domain, category).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), (F.grouping(domain) + F.grouping(category)).alias("level"))


def by_many_keys(answers: DataFrame, keys: list[str], lists: list[str], correct: str) -> DataFrame:
    """``(key, value, good, n, acc)`` of each value of each key, percent to two places; list keys count a row under each of their values."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys)) if keys else F.array().cast("array<struct<key:string,value:string>>")

    def named(k: str) -> Column:
        return F.transform(k, lambda v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))

    more = [named(k) for k in lists]
    long = answers.select(F.explode(F.concat(each, *more)).alias("kv"), F.col(correct).alias("good"))
    out = long.groupBy(F.col("kv.key").alias("key"), F.col("kv.value").alias("value")).agg(_n(F.col("good")).alias("good"), F.count("*").alias("n"))
    return out.withColumn("acc", F.format_string("%.2f", F.col("good") / F.col("n") * 100))


def against_baseline(scores: DataFrame, baseline: DataFrame, on: list[str], value: str) -> DataFrame:
    """Scores with their gain over a baseline of the same key."""
    return scores.join(baseline.withColumnRenamed(value, "__base"), on).withColumn("gain", F.round(F.col(value) - F.col("__base"), 2)).drop("__base")


def bleu_parts(pairs: DataFrame, pred: str, gold: str, orders: int = 4) -> DataFrame:
    """One row of corpus counts: ``match1, total1, ...`` by clipped n-grams, and both lengths.  Texts are split at white space."""

    def grams(words: Column, n: int) -> Column:
        k = F.size(words) - n + 1
        return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    def matched(a: Column, b: Column) -> Column:
        count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
        return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))

    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    rows = pairs.select(split(F.col(pred)).alias("p"), split(F.col(gold)).alias("g"))
    each = [c for n in range(1, orders + 1) for c in (F.sum(matched(grams(F.col("p"), n), grams(F.col("g"), n))).alias(f"match{n}"), F.sum(F.greatest(F.size("p") - n + 1, F.lit(0))).alias(f"total{n}"))]
    return rows.agg(*each, F.sum(F.size("p")).alias("pred_len"), F.sum(F.size("g")).alias("gold_len"))


def bleu(pairs: DataFrame, pred: str, gold: str, orders: int = 4) -> DataFrame:
    """``bleu1`` .. of a corpus: the geometric mean of clipped precisions times the brevity penalty."""
    parts = bleu_parts(pairs, pred, gold, orders)
    p = [F.when(F.col(f"total{n}") > 0, F.greatest(F.col(f"match{n}").cast("double"), F.lit(1e-15)) / F.col(f"total{n}")).otherwise(1e-15) for n in range(1, orders + 1)]
    penalty = F.when(F.col("pred_len") >= F.col("gold_len"), 1.0).otherwise(F.exp(1 - F.col("gold_len") / F.greatest(F.col("pred_len"), F.lit(1))))
    return parts.select(*((penalty * F.exp(reduce(lambda a, b: a + b, [F.log(x) for x in p[:n]]) / n)).alias(f"bleu{n}") for n in range(1, orders + 1)))


def step_losses(logs: DataFrame, step: str, loss: str, tokens: str, world: int) -> DataFrame:
    """Totals over processes at each step and the loss per token; ``scaled``: each process's weight ``world / total``."""
    out = logs.groupBy(step).agg(F.sum(loss).alias("loss_sum"), F.sum(tokens).alias("tokens"))
    return out.withColumn("loss", _ratio(F.col("loss_sum"), F.col("tokens"))).withColumn("scale", _ratio(F.lit(float(world)), F.col("tokens")))


def step_rate(logs: DataFrame, run: str, step: str, seconds: str) -> DataFrame:
    """Steps per second between consecutive log lines of a run."""
    w = Window.partitionBy(run).orderBy(step)
    return logs.withColumn("rate", (F.col(step) - F.lag(step).over(w)) / (F.col(seconds) - F.lag(seconds).over(w)))


def rule_verdict(objects: Column, include: Column, exclude: Column) -> Column:
    """struct(correct, reasons) of counted objects (map of class to boxes, best first) against rules.

    ``include``: array of struct(class, count, position, target); ``exclude``: array of
    struct(class, count).  A position holds between each of the needed objects and
    each of the target rule's, which is an earlier one.
    """
    from spindle.functions.geometry import relative_position

    def have(name: Column) -> Column:
        return F.coalesce(F.try_element_at(objects, name), F.array().cast("array<array<double>>"))

    found = lambda r: F.slice(have(r["class"]), 1, r["count"])
    counted = lambda r: F.size(found(r)) >= r["count"]

    def placed(r: Column) -> Column:
        target = F.get(include, r["target"])
        return F.when(r["position"].isNull(), True).otherwise(
            counted(target) & F.forall(found(r), lambda a: F.forall(found(target), lambda b: F.array_contains(relative_position(a, b), r["position"])))
        )

    none = F.lit(None).cast("string")
    missing = F.transform(
        include,
        lambda r: F.when(~counted(r), F.concat(F.lit("expected "), r["class"], F.lit(">="), r["count"].cast("string"), F.lit(", found "), F.size(found(r)).cast("string")))
        .when(~placed(r), F.concat(F.lit("expected "), r["class"], F.lit(" "), r["position"], F.lit(" target")))
        .otherwise(none),
    )
    extra = F.transform(exclude, lambda r: F.when(F.size(have(r["class"])) >= r["count"], F.concat(F.lit("expected "), r["class"], F.lit("<"), r["count"].cast("string"), F.lit(", found "), F.size(have(r["class"])).cast("string"))).otherwise(none))
    reasons = F.array_compact(F.concat(missing, extra))
    return F.struct((F.size(reasons) == 0).alias("correct"), reasons.alias("reasons"))
