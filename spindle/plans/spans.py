"""Spans: where each plan item's tokens lie in a packed sequence, with labels, positions and attention.

Items are rows ``(sample, place, type, n, loss, enable_cfg, ...)`` with ``n`` content tokens.
Everything is a running sum over a sample's items; token-level arrays are only
made where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.det import let

#: Marks around content: a text has a begin and an end token, an image or video a start and an end token.
MARKS = 2


def rope_step(kind: Column, n: Column, frames: Column, loss: Column, delta: Column) -> Column:
    """How far an item moves the position: a text by its length, patches by 1, latents by a frame distance or 1 unless predicted, a video by its frames more."""
    still = F.when(delta.isNotNull(), delta).when(loss == 0, 1).otherwise(0)
    return F.when(kind == "text", n + MARKS).when(kind == "vit_image", 1).when(kind == "vae_video", frames + still).otherwise(still)


def attention_mode(kind: Column, loss: Column, delta: Column) -> Column:
    return F.when(kind == "text", "causal").when(kind == "vit_image", "full").when((loss == 1) & delta.isNull(), "noise").otherwise("full")


def spans(items: DataFrame, sample: list[str] | str, place: str = "place", dropped: Column | None = None) -> DataFrame:
    """Items with ``len, start, end, rope, mode`` and the places where losses apply.

    ``start`` counts from 0 in the sample; a dropped item has no tokens, but a dropped
    image still moves the position by 1.
    """
    keys = [sample] if isinstance(sample, str) else sample
    gone = dropped if dropped is not None else F.lit(False)
    kind = F.col("type")
    length = F.when(gone, 0).otherwise(F.col("n") + MARKS)
    step = F.when(gone, F.when(kind == "text", 0).otherwise(1)).otherwise(rope_step(kind, F.col("n"), F.col("frames"), F.col("loss"), F.col("frame_delta")))
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sized = items.withColumn("dropped", gone).withColumn("len", length.cast("long")).withColumn("__step", step.cast("long"))
    placed = sized.withColumn("start", F.sum("len").over(before) - F.col("len")).withColumn("rope", F.sum("__step").over(before) - F.col("__step"))
    loss = (F.col("loss") == 1) & ~F.col("dropped")
    text = kind == "text"
    return placed.drop("__step").withColumns({
        "end": F.col("start") + F.col("len"),
        "mode": F.when(~F.col("dropped"), attention_mode(kind, F.col("loss"), F.col("frame_delta"))),
        "ce_start": F.when(loss & text, F.col("start")), "ce_end": F.when(loss & text, F.col("start") + F.col("n") + 1),
        "mse_start": F.when(loss & ~text, F.col("start") + 1), "mse_end": F.when(loss & ~text, F.col("start") + F.col("n") + 1),
    })


def token_positions(start: Column, length: Column) -> Column:
    return F.when(length > 0, F.sequence(start, start + length - 1)).otherwise(F.array().cast("array<bigint>"))


def rope_positions(kind: Column, rope: Column, n: Column, frames: Column) -> Column:
    """A position for each token: ascending in a text, one for an image, one for each frame of a video."""
    per = F.when(frames > 0, F.floor(n / F.greatest(frames, F.lit(1)))).otherwise(0).cast("int")
    video = F.concat(F.array(rope), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1)).cast("int")), lambda i: F.array_repeat(rope + i, per))), F.array(rope + frames + 1))
    return F.when(kind == "text", F.sequence(rope, rope + n + MARKS - 1)).when(kind == "vae_video", video).otherwise(F.array_repeat(rope, (n + MARKS).cast("int")))


def shifted_labels(ids: Column, end_id: int) -> Column:
    """Labels of a begin token and a text's ids: the ids, then the end."""
    return F.concat(ids, F.array(F.lit(end_id)))


def can_attend(query: Column, key: Column, q_mode: Column, q_span: Column, k_mode: Column, k_span: Column) -> Column:
    """Whether a token sees another of its sample: earlier ones, all of its own image, and noise only from within."""
    same = q_span == k_span
    visible = F.when(same, F.when(q_mode == "causal", key <= query).otherwise(True)).otherwise(key < query)
    return F.when((k_mode == "noise") & ~same, False).otherwise(visible)


def not_foreign_noise(q_doc: Column, k_doc: Column, k_mode: Column, q_span: Column, k_span: Column) -> Column:
    """The sparse form as it is in the reference: one document, and no noise of another span; order plays no part."""
    return (q_doc == k_doc) & ~((k_mode == "noise") & (q_span != k_span))


def span_mask(spanned: DataFrame, sample: list[str], place: str = "place") -> DataFrame:
    """For each pair of a sample's spans: the number of (query, key) token pairs that attend."""
    q = spanned.where("len > 0").select(*sample, *(F.col(c).alias("q_" + c) for c in (place, "len", "mode")))
    k = spanned.where("len > 0").select(*sample, *(F.col(c).alias("k_" + c) for c in (place, "len", "mode")))
    same = F.col("q_" + place) == F.col("k_" + place)
    n = F.col("q_len")
    pairs = F.when(same & (F.col("q_mode") == "causal"), F.floor(n * (n + 1) / 2)).when(same, n * n).when((F.col("k_mode") != "noise") & (F.col("k_" + place) < F.col("q_" + place)), n * F.col("k_len")).otherwise(0)
    return q.join(k, sample).withColumn("pairs", pairs.cast("long"))


def padded_splits(lens: Column, modes: Column, maximum: int) -> Column:
    """struct(lens, modes) with one causal split that fills up to ``maximum``."""
    rest = F.lit(maximum) - F.aggregate(lens, F.lit(0).cast("bigint"), lambda s, x: s + x)
    more = rest > 0
    return F.struct(F.when(more, F.array_append(lens, rest)).otherwise(lens).alias("lens"), F.when(more, F.array_append(modes, F.lit("causal"))).otherwise(modes).alias("modes"))


def dense_mask(lens: Column, modes: Column) -> Column:
    """Rows of 0 and -Infinity for one small sample."""
    n = F.aggregate(lens, F.lit(0), lambda s, x: s + x.cast("int"))
    owner = F.flatten(F.transform(lens, lambda x, i: F.array_repeat(i, x.cast("int"))))

    def cell(q: Column, k: Column) -> Column:
        a, b = F.get(owner, q), F.get(owner, k)
        return F.when(can_attend(q, k, F.get(modes, a), a, F.get(modes, b), b), F.lit(0.0)).otherwise(F.lit(float("-inf")))

    return F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.transform(F.sequence(F.lit(0), n - 1), lambda k: cell(q, k)))


#: Elements that one round of ``_sums`` adds; four rounds reach all of any array.
_ROUND = 256


def _sums(a: Column, reach: int = 1) -> Column:
    """Sums of an array up to each element.  A round adds those of the 255 parts of ``reach`` elements before, so no sum runs over all before."""
    if reach >= 1 << 31:  # arrays are shorter
        return a
    parts = lambda i: F.sequence(F.lit(0), F.least(F.lit(_ROUND - 1), F.floor(i / reach).cast("int")))
    wider = F.transform(a, lambda _, i: F.aggregate(parts(i), F.lit(0).cast("bigint"), lambda s, j: s + F.get(a, i - j * reach)))
    return let(F.when(F.size(a) > reach, wider).otherwise(a), lambda b: _sums(b, reach * _ROUND))


def inference_index(lens: Column, new: Column) -> Column:
    """struct(query, cached) places of each sequence's new tokens and of its cache, where sequences follow each other."""
    both = F.zip_with(lens, new, lambda a, b: a + b)
    sums = let(both, lambda b: _sums(b))

    def places(starts: Column) -> Column:
        return F.struct(
            F.flatten(F.zip_with(F.arrays_zip(starts.alias("s"), lens.alias("l")), new, lambda x, b: token_positions(x["s"] + x["l"], b))).alias("query"),
            F.flatten(F.zip_with(starts, lens, token_positions)).alias("cached"),
        )

    return let(let(sums, lambda t: F.transform(t, lambda _, i: F.when(i > 0, F.get(t, i - 1)).otherwise(0).cast("bigint"))), places)


def inference_places(rows: DataFrame, sample: list[str], order: str, lens: str, new: str) -> DataFrame:
    """``inference_index`` of samples of any number of sequences: rows with their own ``query`` and ``cached`` places."""
    before = Window.partitionBy(*sample).orderBy(order, lens, new).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__s", F.coalesce(F.sum(F.col(lens) + F.col(new)).over(before), F.lit(0).cast("bigint")))
    return placed.withColumns({"query": token_positions(F.col("__s") + F.col(lens), F.col(new)), "cached": token_positions(F.col("__s"), F.col(lens))}).drop("__s")
