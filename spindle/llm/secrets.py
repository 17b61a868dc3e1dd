"""Secret scan with DataFrame operations only: candidates by pattern, false positives removed by a random forest.

A cheap pattern finds texts that hold any candidate; only those are cut into
candidates with their surroundings.  Features (length, character transitions,
dictionary coverage, path and neighbouring words) are column expressions.  The
forest is trained on labelled findings by the driver and turned into one column
expression, a sum of nested conditions, so scoring stays in generated code.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.trees import Trees, forest

BEFORE, AFTER = 48, 16
TREES, DEPTH = 25, 6

# Words around secrets, words around other long tokens, and common word parts.
SECRET_WORDS = ("token", "secret", "passwd", "password", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "client_secret")
_START = r"(?<![A-Za-z0-9+/_.~-])"
#: A candidate: an unbroken token of at least 16 characters, padded or not; what it holds is up to the forest.
TOKEN = r"[A-Za-z0-9+/_.~-]{16,}={0,2}"
#: A secret word and an assignment.
ASSIGNMENT = rf"(?i:{'|'.join(sorted(SECRET_WORDS, key=len, reverse=True))})[\"']?\s{{0,2}}(?::=|=>|[:=])\s{{0,2}}[\"']?"
_PLAIN = r"[^\s\"'`<>(){}\[\],;]"
#: Or what follows these, shorter or with other characters, up to the next such token.
ASSIGNED = rf"(?![:=>])(?:(?!{_START}[A-Za-z0-9+/_.~-]{{16}}){_PLAIN}){{4,256}}+"
#: Places of candidates; their surroundings are 48 characters before and 16 after at most, over line ends too.
FINDING = rf"({_START}{TOKEN}|(?<=[:=>\s\"'])(?<={ASSIGNMENT}){ASSIGNED})"
#: A text without either is not cut.
HINT = rf"[A-Za-z0-9+/_.~-]{{16}}|{ASSIGNMENT}{_PLAIN}{{4}}"
OTHER_WORDS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "revision", "uuid", "guid", "etag", "integrity", "version", "http", "href", "src")
DICTIONARY = (
    "account", "action", "address", "admin", "application", "array", "block", "build", "button", "cache", "check", "class", "client", "code", "color", "column", "config", "content", "control", "count", "create",
    "data", "default", "delete", "description", "document", "error", "event", "example", "field", "file", "filter", "format", "function", "group", "handler", "header", "image", "index", "info", "input", "item",
    "language", "length", "level", "library", "line", "link", "list", "local", "manager", "message", "method", "model", "module", "name", "node", "number", "object", "option", "order", "output", "package", "page",
    "parameter", "parent", "path", "pattern", "position", "process", "project", "property", "provider", "query", "random", "record", "release", "request", "resource", "response", "result", "return", "search",
    "section", "select", "server", "service", "session", "setting", "simple", "size", "source", "start", "state", "status", "storage", "string", "style", "system", "table", "target", "template", "test", "text",
    "time", "title", "type", "update", "user", "value", "version", "view", "window", "word", "write", "tion", "ment", "able", "ness", "ight", "ould", "ing", "the", "and", "for", "that", "with", "from",
)
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "transitions", "vowels", "hex", "dictionary", "runs", "slashes", "dots", "is_path", "secret_word", "other_word", "assigned", "quoted", "dashed_uuid")


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(add, [F.when(F.contains(text, F.lit(w)), 1.0).otherwise(0.0) for w in words])


def feature_columns(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """All features as columns of doubles; shares are of the candidate's length."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    near = F.lower(before)
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "vowels": share("[aeiouAEIOU]"),
        "hex": F.when(value.rlike("^(0x)?[0-9a-fA-F]+$"), 1.0).otherwise(0.0),
        "dictionary": 1.0 - F.length(F.regexp_replace(F.lower(value), words, "")) / n,
        "runs": share("(.)\\1\\1"),
        "slashes": share("/"),
        "dots": share("\\."),
        "is_path": F.when(value.rlike("^[./~]?[A-Za-z0-9_-]*(/[A-Za-z0-9_.-]+)+$|\\.[a-z]{1,4}$"), 1.0).otherwise(0.0),
        "secret_word": _hits(near, SECRET_WORDS),
        "other_word": _hits(near, OTHER_WORDS),
        "assigned": F.when(before.rlike("[:=]\\s*[\"']?$"), 1.0).otherwise(0.0),
        "quoted": F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1.0).otherwise(0.0),
        "dashed_uuid": F.when(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), 1.0).otherwise(0.0),
    }


def labelled_findings(n: int = 240) -> list[tuple[str, str, str, int]]:
    """(value, before, after, secret) made by rule: tokens of usual formats and contexts, and long tokens that are none."""

    def noise(i: int, alphabet: str, size: int) -> str:
        raw = b"".join(hashlib.sha512(f"{i}:{size}:{j}".encode()).digest() for j in range(size // 64 + 1))
        return "".join(alphabet[b % len(alphabet)] for b in raw[:size])

    hexa, digits, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    upper = lower.upper()
    base, safe = lower + upper + digits + "+/", lower + upper + digits + "_-"
    out: list[tuple[str, str, str, int]] = []
    for i in range(n):
        size = 20 + 4 * (i % 12)
        word = SECRET_WORDS[i % len(SECRET_WORDS)]
        other = OTHER_WORDS[i % len(OTHER_WORDS)]
        w = [DICTIONARY[(i * 7 + j * 13) % len(DICTIONARY)] for j in range(5)]
        quote = ('"', "'", "")[i % 3]
        lead = (f"{word} = {quote}", f"{word}: {quote}", f"my_{word}={quote}", f"x {word} {quote}", f"the {w[0]} {word.upper()} = {quote}")[i % 5]
        made = (noise(i, hexa, 40), noise(i, base, size), noise(i, safe, size), noise(i, hexa, 32), noise(i, lower + digits, size))[i % 5]
        out.append((made, lead, quote, 1))
        prefix = ("AKIA", "ghp_", "sk-", "xoxb-", "AIza")[i % 5]
        out.append((prefix + noise(i, upper + digits if prefix == "AKIA" else safe, 16 if prefix == "AKIA" else 36), (lead, "", f"{w[0]} ", f"{w[1]}: ")[i % 4], quote, 1))
        out.append((noise(i, hexa, 64 if i % 2 else 40), f"{other} {quote}" if i % 2 else f"{other}: ", quote, 0))
        u = noise(i, hexa, 32)
        out.append(("-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:])), (f"id {quote}", f"{other} = {quote}", f"{word}_id: {quote}")[i % 3], quote, 0))
        out.append(("/".join(w[: 3 + i % 3]) + (".py", ".json", "", ".html")[i % 4], (f"{other}=", "see ", f"{word} file ")[i % 3], "", 0))
        out.append(("_".join(w[:3]) + ("", "_v2", "2024")[i % 3], ("", f"{w[3]} = ", f"{word} = ")[i % 3], "", 0))
        out.append((w[0] + "".join(x.capitalize() for x in w[1:4]) + ("", "1")[i % 2], ("new ", f"{word}(", "")[i % 3], "", 0))
        out.append((noise(i, digits, 16 + i % 8), ("call ", f"{w[0]}: ", "")[i % 3], "", 0))
        out.append(((("x", "0", "your", "-", "=")[i % 5] * 24)[: 18 + i % 9], f"{word} = {quote}", quote, 0))
        out.append((".".join(("192", "168", str(i % 256), str(i * 7 % 256))) + "." * 6, "", "", 0))
        out.append(("".join(w[:4])[:40].ljust(16, "e"), ("", "the ")[i % 2], "", 0))
        assigned = (f"{word} = {quote}", f"{word}: {quote}", f"my_{word}={quote}")[i % 3]
        out.append((noise(i, lower + upper, 16 + i % 24), assigned, quote, 1))
        out.append(("".join(x.capitalize() for x in w[: 3 + i % 2]), assigned, quote, 1))
        out.append((noise(i, base[:62] + "@!$#:%&*", 7 + i % 9), assigned, quote, 1))
        out.append((w[0].capitalize() + ("@", "!", "$", "#", "")[i % 5] + noise(i, digits, 2 + i % 4), assigned, quote, 1))
        out.append(((w[0], w[0].capitalize(), f"{w[0]}.", "None", "true", "null", "string", "required")[i % 8], assigned, quote, 0))
        out.append((f"{w[0]}.{w[1]}", assigned, "(", 0))
        out.append((("https://" + "/".join(w[:2]), f"${{{w[0]}", f"${w[0].upper()}", f"%{w[0]}%")[i % 4], assigned, quote, 0))
        out.append(("".join(w[:3]).ljust(16, "e"), ("of ", f"{w[3]}: ", f"{other} ")[i % 3], "", 0))
    return out


@lru_cache(maxsize=4)
def _trained(app: str, n: int) -> Trees:
    spark = SparkSession.active()
    rows = spark.createDataFrame(labelled_findings(n), "value string, before string, after string, secret int")
    cols = feature_columns(F.col("value"), F.col("before"), F.col("after"))
    found = rows.select("secret", *(c.alias(k) for k, c in cols.items())).orderBy("secret", *cols).collect()
    x = np.array([[r[k] for k in FEATURES] for r in found], dtype=float)
    return forest(x, np.array([r.secret for r in found], dtype=float), TREES, DEPTH)


def as_column(trees: Trees, features: list[Column]) -> Column:
    """The ensemble's value as one expression."""

    def node(i: int) -> Column:
        if trees.left[i] == i:
            return F.lit(float(trees.value[i]))
        return F.when(features[trees.feature[i]] <= float(trees.threshold[i]), node(trees.left[i])).otherwise(node(trees.right[i]))

    return reduce(add, [node(r) for r in trees.roots], F.lit(trees.base))


#: Elements of an array whose running sums are made together.
BLOCK = 64
#: Findings, with what stands before each, that BEFORE characters can reach back over: a short value and its assignment have eight at least; AFTER likewise.
BACK, AHEAD = 6, 3


def running_sums(sizes: Column) -> Column:
    """For each element of an array of sizes, the sum of those before it.

    Blocks are summed, then each block runs on from the sum of the blocks before: appending
    to an array copies it, so that one run over all would take time with the square of its length.
    """

    def run(values: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums"))
        return F.aggregate(values, F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums")), step, lambda s: s["sums"])

    n = F.ceil(F.size(sizes) / BLOCK).cast("int")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<bigint>>"))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, run(sums, F.lit(0)), run))


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, start, value, before, after)`` of every candidate: its number, place and surroundings.

    Texts are cut once; places are running sums of the cut parts' lengths, and surroundings are put together from
    parts nearby, so that the work grows with a text's length and a candidate's row holds no text.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").rlike(HINT))
    cut = texts.select("doc_id", F.regexp_extract_all("text", F.lit(FINDING), F.lit(1)).alias("values"), F.split("text", FINDING, -1).alias("pieces"))
    last, first = lambda c, n: F.transform(c, lambda x: F.right(x, F.lit(n))), lambda c, n: F.transform(c, lambda x: F.left(x, F.lit(n)))
    sizes = F.zip_with(F.transform("pieces", F.length), F.transform("values", F.length), lambda p, v: (p + F.coalesce(v, F.lit(0))).cast("long"))
    parts = cut.select(
        "doc_id", "values", F.transform("pieces", F.length).alias("lengths"), running_sums(sizes).alias("sums"),
        last("pieces", BEFORE).alias("tails"), last("values", BEFORE).alias("value_tails"), first("pieces", AFTER).alias("heads"), first("values", AFTER).alias("value_heads"),
    )
    empty = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))

    def finding(value: Column, i: Column) -> Column:
        back = [x for j in range(BACK, 0, -1) for x in (empty("tails", i - j), empty("value_tails", i - j))]
        ahead = [x for j in range(1, AHEAD + 1) for x in (empty("heads", i + j), empty("value_heads", i + j))]
        return F.struct(
            (F.get("sums", i) + F.get("lengths", i)).alias("start"), value.alias("value"),
            F.right(F.concat(*back, empty("tails", i)), F.lit(BEFORE)).alias("before"), F.left(F.concat(*ahead), F.lit(AFTER)).alias("after"),
        )

    return parts.select("doc_id", F.posexplode(F.transform("values", finding)).alias("n", "c")).select("doc_id", F.col("n").cast("long").alias("n"), "c.*")


def scan_secrets(docs: DataFrame, at_least: float = 0.5, findings: int = 240) -> DataFrame:
    """``(doc_id, n, start, value, score, is_secret)`` for every candidate of ``docs(doc_id, text, ...)``.

    n: number of the candidate in its text, from 0; start: its place in characters; a candidate whose
    score is ``at_least`` is a secret.  Null texts and texts without candidates give no row; texts of any length
    are cut whole.  Candidates of repeated and null doc_ids keep their rows, and equal
    surroundings get equal scores; extra columns are ignored; an empty table gives an empty result.
    """
    model = _trained(docs.sparkSession.sparkContext.applicationId, findings)
    cols = feature_columns(F.col("value"), F.col("before"), F.col("after"))
    scored = candidates(docs).select("doc_id", "n", "start", "value", *(c.alias(k) for k, c in cols.items()))
    score = as_column(model, [F.col(k) for k in FEATURES])
    return scored.select("doc_id", "n", "start", "value", score.alias("score")).withColumn("is_secret", F.col("score") >= at_least)
