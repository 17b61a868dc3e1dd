"""Questions, prompts and prompt suites as text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.det import below, digest
from spindle.functions.text import plural, with_article

# Fixed values.
COLORS = ("red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "black", "white")
POSITIONS = ("left of", "right of", "above", "below")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def question(text: Column, suffix: str = "", examples: Column | None = None) -> Column:
    """A question with its suffix, after few-shot examples."""
    full = F.concat_ws(" ", text, F.lit(suffix)) if suffix else text
    return F.concat(F.array_join(examples, ""), full) if examples is not None else full


def filled(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` replaced by columns (null as empty)."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), columns.items(), F.lit(template))


def option_question(text: Column, options: Column, hint: Column | None = None, closing: str = "Answer with the option's letter from the given choices directly.") -> Column:
    """Hint, question, lettered options and the closing line."""
    from spindle.functions.answers import lettered

    return F.concat_ws("\n", hint, text, lettered(options), F.lit(closing)) if hint is not None else F.concat_ws("\n", text, lettered(options), F.lit(closing))


def instruction(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def extraction_prompt(demo: str, query: Column, response: Column) -> Column:
    return F.concat(F.lit(demo), F.lit("\n\n"), query, F.lit("\n\n"), response, F.lit("\n\nExtracted answer: "))


def is_extracted(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s", "")) > 0, F.lit(False))


def same_answer(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# --- prompt suites ---------------------------------------------------------------------------


def suite(spark: SparkSession, classes: list[str], n: int, seed: int, person: str = "person") -> DataFrame:
    """``(tag, idx, prompt, include, exclude)`` of six kinds of prompts, repeated specifications left out (the first stays).

    One of each class; then ``n`` each of two objects, counts of 2 to 4, colours, positions
    and two coloured objects.  Colours never go to ``person``.
    """
    names = F.array(*map(F.lit, classes))
    k = len(classes)
    place = classes.index(person) if person in classes else 0
    pick = lambda purpose, m: below(m, seed, purpose, "tag", "idx")
    other = lambda first, purpose, m: (first + 1 + pick(purpose, m - 1)) % m
    kinds = [("single_object", k), ("two_object", n), ("counting", n), ("colors", n), ("position", n), ("color_attr", n)]
    rows = reduce(DataFrame.unionByName, [spark.range(m).select(F.lit(t).alias("tag"), F.lit(i).alias("kind"), F.col("id").alias("idx")) for i, (t, m) in enumerate(kinds)])
    spec = "array<struct<class:string,count:int,color:string,position:string,target:int>>"

    def rule(name: Column, count: Column | int = 1, color: Column | None = None, position: Column | None = None) -> Column:
        c = count if isinstance(count, Column) else F.lit(count)
        none = F.lit(None).cast("string")
        return F.struct(name.alias("class"), c.cast("int").alias("count"), (color if color is not None else none).alias("color"), (position if position is not None else none).alias("position"), F.when(F.lit(position is not None), 0).alias("target"))

    a = pick("a", k)
    b = other(a, "b", k)
    one, two = F.get(names, a), F.get(names, b)
    count = 2 + pick("count", 3)
    ca = pick("color", len(COLORS))
    color_a, color_b = (F.get(F.array(*map(F.lit, COLORS)), c) for c in (ca, other(ca, "color2", len(COLORS))))
    thing_a = (F.lit(1 + place) + pick("thing", k - 1)) % k
    step = F.pmod(thing_a - place - 1, F.lit(k))
    thing_b = (F.lit(1 + place) + other(step, "thing2", k - 1)) % k
    named_a, named_b = F.get(names, thing_a), F.get(names, thing_b)
    where = F.get(F.array(*map(F.lit, POSITIONS)), pick("where", len(POSITIONS)))
    single = F.get(names, F.col("idx").cast("int"))
    photo = F.lit("a photo of ")
    tag = F.col("tag")
    empty = F.array().cast(spec)
    include = (
        F.when(tag == "single_object", F.array(rule(single)))
        .when(tag == "two_object", F.array(rule(one), rule(two)))
        .when(tag == "counting", F.array(rule(one, count)))
        .when(tag == "colors", F.array(rule(named_a, 1, color_a)))
        .when(tag == "position", F.array(rule(two), rule(one, 1, None, where)))
        .otherwise(F.array(rule(named_a, 1, color_a), rule(named_b, 1, color_b)))
    )
    exclude = F.when(tag == "counting", F.array(rule(one, count + 1))).otherwise(empty)
    prompt = (
        F.when(tag == "single_object", F.concat(photo, with_article(single)))
        .when(tag == "two_object", F.concat(photo, with_article(one), F.lit(" and "), with_article(two)))
        .when(tag == "counting", F.concat(photo, F.get(F.array(*map(F.lit, NUMBERS)), count), F.lit(" "), plural(one)))
        .when(tag == "colors", F.concat(photo, with_article(color_a), F.lit(" "), named_a))
        .when(tag == "position", F.concat(photo, with_article(one), F.lit(" "), where, F.lit(" "), with_article(two)))
        .otherwise(F.concat(photo, with_article(color_a), F.lit(" "), named_a, F.lit(" and "), with_article(color_b), F.lit(" "), named_b))
    )
    full = rows.select("tag", "kind", "idx", prompt.alias("prompt"), include.cast(spec).alias("include"), exclude.cast(spec).alias("exclude"))
    key = F.to_json(F.struct("tag", "prompt", "include", "exclude"))
    return full.groupBy(key.alias("__k")).agg(F.min_by(F.struct(*full.columns), F.struct("kind", "idx")).alias("r")).select("r.*").drop("kind")


def shuffle_key(seed: int, *columns: str) -> Column:
    return digest(seed, "suite", *columns)
