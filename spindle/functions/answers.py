"""Reading answers out of model output, and judging them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.text import strip, strip_chars

# Fixed values.
YES_NO = ("yes", "no")
LETTERS = "ABCDEFGHIJKLM"
TRANSLATED = (("不是", "No"), ("是", "Yes"), ("否", "No"))
# One entry is corrected: "fewest" and "more", which run into one word where a comma is missing.
QUANTITY_WORDS = (
    "most", "least", "fewest", "more", "less", "fewer", "largest", "smallest", "greatest", "larger", "smaller", "greater", "highest", "lowest", "higher", "lower", "increase", "decrease",
    "minimum", "maximum", "max", "min", "mean", "average", "median", "total", "sum", "add", "subtract", "difference", "quotient", "gap", "half", "double", "twice", "triple", "square", "cube", "root",
    "approximate", "approximation", "triangle", "rectangle", "circle", "square", "cube", "sphere", "cylinder", "cone", "pyramid", "multiply", "divide", "percentage", "percent", "ratio", "proportion", "fraction", "rate",
)
COUNT_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "trillion",
)
BOOL_WORDS = ("Yes", "No", "True", "False", "yes", "no", "true", "false", "YES", "NO", "TRUE", "FALSE")
KEYS_BEFORE_ANSWERS = ("could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ")


def yes_no(c: Column) -> Column:
    """``yes``, ``no`` or ``other``: the whole answer, else a word in its first four characters."""
    text = F.lower(c)
    head = F.substring(text, 1, 4)
    return F.when(text.isin(*YES_NO), text).when(head.contains("yes"), "yes").when(head.contains("no"), "no").otherwise("other")


def translated(c: Column) -> Column:
    """Line feeds gone, true/false as Yes/No, other scripts' yes and no translated, their characters removed."""
    text = F.replace(strip(F.replace(F.replace(c, F.lit("\n"), F.lit("")), F.lit("True"), F.lit("Yes"))), F.lit("False"), F.lit("No"))
    for a, b in TRANSLATED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, "[\\u4e00-\\u9fa5]", "")


def first_sentence_no(c: Column) -> Column:
    """Whether the first sentence, commas dropped, has one of No, not, no as a word between blanks."""
    first = F.replace(F.split_part(c, F.lit("."), F.lit(1)), F.lit(","), F.lit(""))
    return F.arrays_overlap(F.split(first, " "), F.array(F.lit("No"), F.lit("not"), F.lit("no")))


def final_answer(c: Column) -> Column:
    """What follows ``Final answer:`` or ``Answer:`` on its line, in any case; the text itself if nothing does."""
    pattern = r"(?i)(?:Final answer:|Answer:)\s*(.*)"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).otherwise(c)


def choice_letter(c: Column, n: Column | int = 4, default: str | None = None) -> Column:
    """The answer's single letter: itself, else the first option letter that is in it; ``default`` for an empty answer."""
    text = strip(c)
    options = F.transform(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1), lambda i: F.char(i + 65))
    found = F.get(F.filter(options, lambda o: F.contains(text, o)), 0)
    out = F.when(F.array_contains(options, text), text).otherwise(F.coalesce(found, text))
    return F.when(text == "", F.lit(default)).otherwise(out) if default is not None else out


def lettered(options: Column) -> Column:
    """``A. text`` lines of an array of options; null options are left out and keep no letter."""
    return F.array_join(F.transform(F.array_compact(options), lambda x, i: F.concat(F.char(i + 65), F.lit(". "), strip(x))), "\n")


def judge_score(c: Column, name: str, default: float = 9.9) -> Column:
    """The last digit that follows a name, with or without stars and a colon; ``default`` if none does."""
    found = F.regexp_extract_all(c, F.lit(rf"(?i){name}\*{{0,2}}\s*[:：]?\s*(\d)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("double"), F.lit(default))


def number(c: Column) -> Column:
    """A double of a number with commas, else null."""
    return F.when(strip(c).contains("_"), None).otherwise(strip(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"))


def normal_forms(c: Column) -> Column:
    """The forms in which a short answer is compared: a number to 2 places, a single character beside a blank, else lower case."""
    text, value = strip(c), number(c)
    low = F.lower(text)
    return F.when(value.isNotNull(), F.array(F.bround(value, 2).cast("string"))).when(F.length(text) == 1, F.array(F.concat(F.lit(" "), low), F.concat(low, F.lit(" ")))).otherwise(F.array(low))


def numbers_in(c: Column) -> Column:
    """All numbers of a text: with thousands commas, scientific, then plain ones."""
    each = (r"-?\b\d{1,3}(?:,\d{3})+\b", r"-?\d+(?:\.\d+)?[eE][+-]?\d+", r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])")
    return F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in each))


def parsed_choice(response: Column, options: Column) -> Column:
    """The letter that a free response gives among ``options`` (texts of A, B, ...); null where none is found.

    Letters in brackets count first, then letters between blanks, then option texts
    if the response has more than five words; of several, the one that stands last.
    """
    text = response
    for ch in (",", ".", "!", "?", ";", ":", "'"):
        text = strip_chars(text, ch)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    low = F.lower(text)

    def found(hay: Column, needle) -> Column:
        # distance of the last occurrence from the end: the part after the last split
        keyed = F.transform(
            options,
            lambda o, i: F.struct(
                F.length(F.element_at(F.split(hay, F.concat(F.lit("\\Q"), needle(o, i), F.lit("\\E")), -1), -1)).alias("rest"),
                i.alias("i"),
                F.contains(hay, needle(o, i)).alias("ok"),
            ),
        )
        return F.char(F.get(F.array_sort(F.filter(keyed, lambda x: x["ok"])), 0)["i"] + 65)

    bracket = found(text, lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(")")))
    spaced = found(text, lambda o, i: F.concat(F.lit(" "), F.char(i + 65), F.lit(" ")))
    content = F.when(F.size(F.split(strip(text), r"\s+")) > 5, found(low, lambda o, i: F.lower(o)))
    return F.coalesce(bracket, spaced, content)


def parsed_open(response: Column, compat: bool = False) -> Column:
    """Forms of what an open response says: the shortest tails after key words, their numbers, all normalised.

    Sentences end at a line feed or at a period before a capital (``compat``: only at
    a line feed, since the text is in lower case by then); the last one may also have
    its answer after an equals sign.
    """
    text = strip_chars(strip(response), ".")
    parts = F.split(F.lower(text), r"\n") if compat else F.transform(F.split(text, r"\.\s(?=[A-Z])|\n"), F.lower)
    none = F.lit(None).cast("string")

    def tail(part: Column, last: Column) -> Column:
        keys = [F.when(part.contains(k), strip(F.element_at(F.split(part, F.lit(k), -1), -1))).otherwise(none) for k in KEYS_BEFORE_ANSWERS]
        keys.append(F.when(last & part.contains("="), strip(F.element_at(F.split(part, F.lit("="), -1), -1))).otherwise(none))
        some = F.transform(F.array_compact(F.array(*keys)), lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t")))
        return F.get(F.array_sort(some), 0)["t"]

    tails = F.transform(parts, lambda p, i: tail(p, i == F.size(parts) - 1))
    good = F.filter(tails, lambda t: t.isNotNull() & (t != "") & ~t.isin(":", ",", ".", "!", "?", ";", "'"))
    keys = F.when(F.size(good) > 0, good).otherwise(F.array(F.lower(text)))
    every = F.concat(keys, F.flatten(F.transform(keys, numbers_in)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(every, normal_forms))))


def open_correct(gold: Column, predicted: Column) -> Column:
    """Whether any form of the gold answers (array) is in a predicted form: equal numbers, or a string inside one."""
    forms = F.flatten(F.transform(gold, normal_forms))
    numeric = lambda x: x.try_cast("double").isNotNull()
    return F.exists(predicted, lambda p: F.exists(forms, lambda g: F.when(numeric(p), g == p).otherwise(~numeric(g) & F.contains(p, g))))


def closest_choice(c: Column, choices: Column) -> Column:
    """The choice of least edit distance, the first of ties."""
    keyed = F.transform(choices, lambda x, i: F.struct(F.levenshtein(c, x).alias("d"), i.alias("i"), x.alias("x")))
    return F.array_min(keyed)["x"]


def normal_extraction(c: Column, choices: Column, question_type: Column, answer_type: Column, precision: Column) -> Column:
    """An extracted answer in the form of the question: a choice, an integer, a float to ``precision`` places, or as it is."""
    text = strip(c)
    bracket = F.regexp_extract(text, r"\(([a-zA-Z])\)", 1)
    letter = F.when(bracket != "", F.upper(bracket)).otherwise(text)
    index = F.ascii(letter) - 65
    is_letter = (F.length(letter) == 1) & index.between(0, F.size(choices) - 1)
    chosen = F.when(is_letter, F.get(choices, F.when(is_letter, index).otherwise(0))).otherwise(closest_choice(letter, choices))
    value = F.when(text.contains("_"), None).otherwise(text.try_cast("double"))
    scale = F.pow(F.lit(10.0), precision)
    return (
        F.when(question_type == "multi_choice", chosen)
        .when(answer_type == "integer", F.when(F.abs(value) < 1e18, value.cast("bigint")).cast("string"))
        .when(answer_type == "float", (F.rint(value * scale) / scale).cast("string"))
        .otherwise(c)
    )


def rule_extraction(response: Column, choices: Column, question_type: Column, answer_type: Column) -> Column:
    """An answer found without a judge: a choice itself, an integer or a float; null if none applies, empty for empty."""
    text = strip(response)
    integer = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint").cast("string"))
    return (
        F.when(response == "", "")
        .when((question_type == "multi_choice") & F.array_contains(choices, response), response)
        .when((answer_type == "integer") & integer.isNotNull(), integer)
        .when((answer_type == "float") & ~text.contains("_"), text.try_cast("double").cast("string"))
    )


# --- predicates -------------------------------------------------------------------------


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\b\w+\b"), F.lit(0))


def has_number_word(c: Column) -> Column:
    return F.arrays_overlap(_words(c), F.array(*map(F.lit, COUNT_WORDS))) | has_digit(c)


def has_quantity_word(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.arrays_overlap(_words(c), F.array(*map(F.lit, [*QUANTITY_WORDS, *extra])))


def is_bool_word(c: Column) -> Column:
    return c.isin(*BOOL_WORDS)


def is_digit_string(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\.0+$", "").rlike(r"^[+-]?\d+$")


def is_float_string(c: Column) -> Column:
    return c.contains(".") & strip(c).try_cast("double").isNotNull()


# --- scores of one answer -----------------------------------------------------------------


def soft_accuracy(pred: Column, golds: Column) -> Column:
    """Leave-one-out accuracy of a normalised answer against ten golds: min(1, other matches / 3), averaged."""
    k = F.size(F.filter(golds, lambda g: g == pred))
    return F.when(k > 0, (k * F.least(F.lit(1.0), (k - 1) / 3) + (10 - k) * F.least(F.lit(1.0), k / 3)) / 10).otherwise(0.0)


def anls(pred: Column, golds: Column, threshold: float = 0.5) -> Column:
    """The best of 1 - distance / longer length over golds, 0 below the threshold; two empty strings are alike."""
    low = F.lower(strip(pred))

    def one(g: Column) -> Column:
        other = F.lower(strip(g))
        longer = F.greatest(F.length(low), F.length(other))
        s = F.when(longer > 0, 1 - F.levenshtein(low, other) / longer).otherwise(1.0)
        return F.when(s < threshold, 0.0).otherwise(s)

    return F.array_max(F.transform(golds, one))


def _value(c: Column) -> Column:
    raw = F.when(c.endswith("%"), F.regexp_replace(c, "%+$", "")).otherwise(c)
    return F.when(raw.contains("_"), None).otherwise(strip(raw).try_cast("double")) / F.when(c.endswith("%"), 100.0).otherwise(1.0)


def relaxed_correct(target: Column, prediction: Column, tolerance: float = 0.05) -> Column:
    """Numbers within ``tolerance`` of the target, or texts equal in any case (also where the target is 0)."""
    t, p = _value(target), _value(prediction)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), F.abs(p - t) / F.abs(t) <= tolerance).otherwise(F.lower(prediction) == F.lower(target))


def exact_match(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.lower(strip(g)) == F.lower(strip(pred)))


def short_answer(response: Column) -> Column:
    """The head of a sentence without its verb and article."""
    text = strip(response)
    for mark in (".", ",", "!"):
        text = F.split_part(text, F.lit(mark), F.lit(1))
    text = F.lower(text)
    for word in ("is ", "are ", "a ", "an ", "the "):
        text = F.when(text.contains(word), F.split_part(text, F.lit(word), F.lit(2))).otherwise(text)
    return strip(F.split_part(text, F.lit(" of"), F.lit(1)))
