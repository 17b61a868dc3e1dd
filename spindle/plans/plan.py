"""Sequence plans: what a sample is made of, as an array of items in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.det import uniform
from spindle.functions.text import strip

ITEM = "struct<type:string,enable_cfg:int,loss:int,special_token_loss:int,special_token_label:int,split_start:boolean,split_end:boolean,frame_delta:int>"


def item(kind: str, loss: Column | int = 0, cfg: Column | int = 0, first: Column | bool = True, last: Column | bool = True, delta: Column | None = None) -> Column:
    """One item; images of one video share a split, from ``first`` to ``last``, ``delta`` frames apart."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("type"), col(cfg).cast("int").alias("enable_cfg"), col(loss).cast("int").alias("loss"), F.lit(0).alias("special_token_loss"), F.lit(None).cast("int").alias("special_token_label"),
        col(first).cast("boolean").alias("split_start"), col(last).cast("boolean").alias("split_end"), (delta if delta is not None else F.lit(None)).cast("int").alias("frame_delta"),
    ).cast(ITEM)


def text_to_image() -> Column:
    return F.array(item("text", cfg=1), item("vae_image", loss=1))


def text_to_video(first_frame: bool = False) -> Column:
    """A caption, then a video; or its first frame as an image."""
    return F.array(item("text", cfg=1), item("vae_image" if first_frame else "vae_video", loss=1))


def add_text(loss: bool = False, cfg: bool = True) -> Column:
    return F.array(item("text", loss=int(loss), cfg=int(cfg)))


def add_image(loss: bool, vae: bool, vit: bool, cfg: bool = True) -> Column:
    """An image that is predicted, and seen again as latents and as patches."""
    if not (loss or vae or vit):
        raise ValueError("an image has at least one part")
    parts = [item("vae_image", loss=1)] * loss + [item("vae_image", cfg=int(cfg))] * vae + [item("vit_image", cfg=int(cfg))] * vit
    return F.array(*parts)


def add_video(frames: Column, loss: bool, cfg: bool = True) -> Column:
    """Frames (an array of indices) as one split; each but the last knows the distance to the next."""
    n = F.size(frames)
    return F.transform(
        frames,
        lambda f, i: item("vae_image", loss=int(loss), cfg=0 if loss else int(cfg), first=i == 0, last=i == n - 1, delta=F.when(i < n - 1, F.get(frames, F.least(i + 1, n - 1)) - f)),
    )


_ELEMENT = "struct<type:string,has_loss:int,text:string>"


def chat_elements(turns: Column, images: Column) -> Column:
    """Turns (array of struct(from, value)) -> elements struct(type, has_loss, text).

    A human turn without ``<image>`` is one text; with it, texts between marks
    (blank ones left out) and an image for each mark while there are images.  A turn
    of the model is a text with loss; other turns are left out.
    """
    none = F.lit(None)
    text = lambda t, loss: F.struct(F.lit("text").alias("type"), F.lit(loss).alias("has_loss"), t.alias("text")).cast(_ELEMENT)
    image = F.struct(F.lit("image").alias("type"), none.cast("int").alias("has_loss"), none.cast("string").alias("text")).cast(_ELEMENT)
    empty = F.array().cast(f"array<{_ELEMENT}>")

    def human(value: Column) -> Column:
        parts = F.split(value, "<image>", -1)
        n = F.size(parts)
        each = F.transform(parts, lambda p, i: F.concat(F.when(strip(p) != "", F.array(text(strip(p), 0))).otherwise(empty), F.when((i < n - 1) & (i < images), F.array(image)).otherwise(empty)))
        return F.when(value.contains("<image>"), F.flatten(each)).otherwise(F.array(text(value, 0)))

    return F.flatten(F.transform(turns, lambda t: F.when(t["from"] == "human", human(t["value"])).when(t["from"] == "gpt", F.array(text(t["value"], 1))).otherwise(empty)))


def video_turns(turns: Column, frames: Column) -> Column:
    """Turns with the first turn's ``<video>`` as one ``<image>`` for each frame; null if the first turn has none."""
    marks = F.repeat(F.lit("<image>"), frames)
    first = F.get(turns, 0)
    replaced = F.transform(turns, lambda t, i: F.struct(t["from"].alias("from"), F.when(i == 0, F.replace(t["value"], F.lit("<video>"), marks)).otherwise(t["value"]).alias("value")))
    return F.when(first["value"].contains("<video>"), replaced)


def chat_plan(elements: Column) -> Column:
    """Items of elements; empty texts are left out."""
    kept = F.filter(elements, lambda e: (e["type"] == "image") | (F.length(e["text"]) > 0))
    return F.transform(kept, lambda e: F.when(e["type"] == "image", item("vit_image")).otherwise(item("text", loss=F.coalesce(e["has_loss"], F.lit(0)))))


def has_loss(plan: Column) -> Column:
    return F.exists(plan, lambda p: p["loss"] == 1)


def total_tokens(tokens: Column, plan: Column) -> Column:
    """A sample's tokens with the two marks of each item."""
    return tokens + 2 * F.size(plan)


def fits(tokens: Column, plan: Column, limit: int, mandatory: bool = False) -> Column:
    """Whether a sample is short enough; of a mandatory group it has to be below the limit."""
    total = total_tokens(tokens, plan)
    return total < limit if mandatory else total <= limit


#: Chance that a condition is dropped, by item type.
DROPOUT = {"text": 0.1, "vit_image": 0.4, "vae_image": 0.1, "vae_video": 0.1}


def dropped(kind: Column, cfg: Column, place: Column, seed: int, key: Column, chances: dict[str, float] | None = None) -> Column:
    """Whether an item that may be dropped is."""
    chance = F.element_at(F.create_map(*(F.lit(x) for kv in (chances or DROPOUT).items() for x in kv)), kind)
    return (cfg == 1) & (uniform(seed, "dropout", key, place) < F.coalesce(chance, F.lit(0.0)))


def loss_weight(tokens: Column, reduction: str = "square") -> Column:
    """Weight of each of a sample's tokens: 1, 1/n or 1/sqrt(n); 0 for none."""
    n = tokens.cast("double")
    weight = {"token": F.lit(1.0), "sample": 1 / n, "square": 1 / F.sqrt(n)}[reduction]
    return F.when(tokens > 0, weight).otherwise(0.0)
