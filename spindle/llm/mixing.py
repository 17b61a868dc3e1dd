"""Mixing sources to target weights with DataFrame operations only.

Each row gets a hash-random 60-bit key.  A source's rows are ranged by that key
into buckets of about ``BUCKET_ROWS`` rows, each sorted on its own; bucket totals
give the offset of each bucket (a prefix sum over few rows), and a running sum
inside a bucket completes a distributed prefix sum of sizes.  A source's budget
is whole epochs of everything it has, then one more pass cut at the exact word.
A source of any share of the rows is spread over all of its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import BROADCAST_ROWS, WORD, stored

#: Rows of one sorted bucket: few, so that a hot source is dealt over many tasks; a source's totals are a row for each.
BUCKET_ROWS = 2_000
#: Buckets of one span of a source's prefix sum.
SPAN_BUCKETS = 4096
#: A source is repeated this often at most.
MAX_EPOCHS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(s, s_null, rows, source_size)`` -> the same with ``target``.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...  They share the total
    size by weight; a target stops at ``max_epochs`` times the source's size and
    the excess is shared again.  In order of cap / weight that is one level: all
    sources before some rank have their cap, the others weight times level.
    """
    every = Window.partitionBy()
    named = sizes.withColumn("weight", (F.row_number().over(Window.orderBy("s_null", "s")) - 1) % 3 + 1)
    capped = named.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "s_null", "s")
    ranked = (
        capped.withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("left").cast("double"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(every)
    chosen = ranked.withColumn("first", first).withColumn("at", F.min(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(every))
    target = F.when(F.col("rank") < F.col("first"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("at"))
    return chosen.select("s", "s_null", "rows", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source, ...)``.

    size: words of the text (null: 0); taken: words the mix takes of the row,
    repeats counted, at most ``max_epochs`` times its size.  The words taken of a
    source are its target rounded down.  A row of size 0 takes 0; equal rows are
    interchangeable; rows without doc_id are placed by their text; a source of
    size 0 has target 0; texts of any length count whole; extra columns are ignored; an
    empty table gives an empty result.
    """
    return _taken(docs, [], seed, bucket_rows, max_epochs).select("doc_id", "size", "source_size", "target", "taken")


def _key(seed: str):
    place = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), place)), 1, 15), 16, 10).cast("long")


def _taken(docs: DataFrame, also: list[str], seed: str = SEED, bucket_rows: int = BUCKET_ROWS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``mix_sources`` with further columns of the rows."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(*also, "doc_id", size.alias("size"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), _key(seed).alias("key")), "sizes")
    targets = stored(source_targets(rows.groupBy("s", "s_null").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")), max_epochs), "targets")
    on = ["s", "s_null"]
    buckets = F.ceil(F.col("rows") / bucket_rows)
    ranged = rows.join(targets, on).withColumn("bucket", F.shiftright(F.shiftright("key", 30) * buckets, 30))
    inside = Window.partitionBy(*on, "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(_offsets(ranged, on), [*on, "bucket"])
    start = F.col("offset") + F.col("start")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - start))
    return placed.select(*also, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _offsets(ranged: DataFrame, on: list[str]) -> DataFrame:
    """``(..., bucket, offset)``: the words of a source before each bucket, by a prefix sum over spans of buckets and one inside each span."""
    totals = ranged.groupBy(*on, "bucket").agg(F.sum("size").alias("words")).withColumn("span", F.floor(F.col("bucket") / SPAN_BUCKETS))
    up_to = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spans = totals.groupBy(*on, "span").agg(F.sum("words").alias("of_span"))
    before = spans.select(*on, "span", (F.sum("of_span").over(up_to(on, "span")) - F.col("of_span")).alias("before"))
    within = totals.withColumn("within", F.sum("words").over(up_to([*on, "span"], "bucket")) - F.col("words"))
    return within.join(before, [*on, "span"]).select(*on, "bucket", (F.col("before") + F.col("within")).alias("offset"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows the mix takes, each as often as its words are taken (to the nearest whole copy), with the columns of ``docs``.

    The row at a source's cut counts if at least half of it is taken.  Each row is
    taken for itself, whether or not it has a doc_id or shares it with others, so that a source's copies add up
    to its target to within one row.  Rows without words are in no mix; columns of ``docs`` may have any
    names besides doc_id, text and source; an empty table gives an empty result.
    What is taken of a row finds it again by its doc_id where each row has its own, else the rows are
    written once with a number.
    """
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        rows = docs.select(document, F.col("doc_id").alias("row"))
    else:
        rows = stored(docs.select(document, F.monotonically_increasing_id().alias("row")), "rows")
    taken = _taken(rows.select("row", "document.doc_id", "document.text", "document.source"), ["row"], **options)
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    wanted = stored(taken.where("size > 0").select("row", copies.alias("copies")).where("copies > 0"), "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(wanted) if few else wanted, "row")
    return found.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST({MAX_EPOCHS} * source_size AS DOUBLE) / weight AS ratio, sum(source_size) OVER () AS total,
    coalesce(sum({MAX_EPOCHS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining, row_number() OVER o AS rnk
  FROM s WINDOW o AS (ORDER BY CAST({MAX_EPOCHS} * source_size AS DOUBLE) / weight, source NULLS LAST)
), l AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(remaining AS DOUBLE) AS level FROM r
), f AS (SELECT min(rnk) AS first, arg_min(level, rnk) AS level FROM l WHERE level <= ratio
), t AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.rnk < f.first THEN CAST({MAX_EPOCHS} * l.source_size AS DOUBLE) ELSE l.weight * f.level END AS target
  FROM l, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - start)) AS BIGINT) AS taken
FROM p
"""
