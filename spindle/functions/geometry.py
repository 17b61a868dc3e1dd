"""Image and video geometry as column arithmetic: sizes, crops, buckets, boxes, positions.

``round`` is to even, as in IEEE arithmetic; ``//`` is floor division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _even(c: Column) -> Column:
    return F.rint(c)


def _divisible(c: Column, stride: int) -> Column:
    return F.greatest(F.lit(float(stride)), _even(c / stride) * stride)


def _scaled(width: Column, height: Column, scale: Column, stride: int) -> tuple[Column, Column]:
    return _divisible(_even(width * scale), stride), _divisible(_even(height * scale), stride)


def resize_dims(width: Column, height: Column, max_size: int, min_size: int, stride: int, max_pixels: int, images: int = 1, exact_cap: bool = False) -> Column:
    """struct(w, h): the longer edge at most ``max_size``, then the shorter at least ``min_size``, both multiples of ``stride``.

    Above ``max_pixels / images`` the size shrinks by the ratio of areas (as the
    compatible behaviour has it), or with ``exact_cap`` by its square root; a longer
    edge that is still above ``max_size`` shrinks once more.
    """
    w, h = width.cast("double"), height.cast("double")
    scale = F.greatest(F.least(max_size / F.greatest(w, h), F.lit(1.0)), min_size / F.least(w, h))
    w, h = _scaled(w, h, scale, stride)
    cap = max_pixels / images
    shrink = F.sqrt(cap / (w * h)) if exact_cap else cap / (w * h)
    cw, ch = _scaled(w, h, shrink, stride)
    over = w * h > cap
    w, h = F.when(over, cw).otherwise(w), F.when(over, ch).otherwise(h)
    lw, lh = _scaled(w, h, max_size / F.greatest(w, h), stride)
    over = F.greatest(w, h) > max_size
    return F.struct(F.when(over, lw).otherwise(w).cast("int").alias("w"), F.when(over, lh).otherwise(h).cast("int").alias("h"))


def center_crop(height: Column, width: Column, target_h: Column, target_w: Column, top: bool = False) -> Column:
    """struct(i, j, h, w): the largest centred (or top) box of the target's ratio; offsets rounded to even."""
    h, w = height.cast("double"), width.cast("double")
    ratio = target_h / target_w
    tall = h / w > ratio
    new_h = F.when(tall, F.floor(w * ratio)).otherwise(F.floor(h))
    new_w = F.when(tall, F.floor(w)).otherwise(F.floor(h / ratio))
    i = F.lit(0) if top else _even((h - new_h) / 2.0)
    return F.struct(i.cast("int").alias("i"), _even((w - new_w) / 2.0).cast("int").alias("j"), new_h.cast("int").alias("h"), new_w.cast("int").alias("w"))


def crop_box(height: Column, width: Column, target_h: Column, target_w: Column) -> Column:
    """struct(top, bottom, left, right) of the centred box of the target's ratio; offsets rounded down."""
    ratio = target_h.cast("double") / target_w
    tall = height.cast("double") / width >= ratio
    new_h = F.when(tall, F.floor(width * ratio)).otherwise(height)
    new_w = F.when(tall, width).otherwise(F.floor(height / ratio))
    top, left = F.floor((height - new_h) / 2), F.floor((width - new_w) / 2)
    return F.struct(top.cast("int").alias("top"), (top + new_h).cast("int").alias("bottom"), left.cast("int").alias("left"), (left + new_w).cast("int").alias("right"))


def resize_crop(height: Column, width: Column, target_h: int, target_w: int, u: Column) -> Column:
    """struct(resize_h, resize_w, top, left): fill the target, then crop at the place that ``u`` in [0, 1) picks."""
    wide = width / height >= F.lit(target_w / target_h)
    rh = F.when(wide, F.lit(target_h)).otherwise(_even(target_w * (height / width)))
    rw = F.when(wide, _even(target_h * (width / height))).otherwise(F.lit(target_w))
    top = F.when(wide, F.lit(0)).otherwise(F.floor(u * (rh - target_h + 1)))
    left = F.when(wide, F.floor(u * (rw - target_w + 1))).otherwise(F.lit(0))
    return F.struct(*(c.cast("int").alias(n) for c, n in ((rh, "resize_h"), (rw, "resize_w"), (top, "top"), (left, "left"))))


def nearest(value: Column, candidates: list[float]) -> Column:
    """Index of the candidate nearest to ``value``; ties go to the first."""
    return F.array_min(F.array(*(F.struct(F.abs(F.lit(float(c)) - value).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(candidates))))["i"]


def override_resolution(width: Column, height: Column, buckets: list[tuple[int, int]], resolution: int) -> Column:
    """struct(w, h): the (w, h) bucket nearest in ratio, scaled from 512 to ``resolution`` and floored to 64."""
    i = nearest(width / height, [w / h for w, h in buckets])
    sizes = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in buckets))
    picked = F.get(sizes, i)
    scaled = lambda c: (F.floor(c * (resolution / 512) / 64) * 64 if resolution != 512 else c).cast("int")
    return F.struct(scaled(picked["w"]).alias("w"), scaled(picked["h"]).alias("h"))


def image_tokens(width: Column, height: Column, stride: int) -> Column:
    return F.floor(width * height / (stride * stride)).cast("bigint")


def video_tokens(frames: Column, width: Column, height: Column, temporal: int = 4, stride: int = 16) -> Column:
    """Latent frames ``(t - 1) // temporal + 1`` times the patches of one."""
    return ((F.floor((frames - 1) / temporal) + 1) * F.floor(width * height / (stride * stride))).cast("bigint")


def position_ids(rows: Column, cols: Column, side: int, frames: Column | int = 1) -> Column:
    """Flat row-major ids ``r * side + c``, once for each frame."""
    one = F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: r * side + c)))
    n = F.lit(frames) if isinstance(frames, int) else frames
    return F.flatten(F.array_repeat(one, n))


def interpolated_position_ids(rows: Column, cols: Column, side: int) -> Column:
    """Flat ids of a grid of any size laid over ``side`` x ``side`` cells: cell of i/n is ``floor(i * side / n)``."""
    cell = lambda i, n: F.floor(i * side / n).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: cell(r, rows) * side + cell(c, cols))))


def sincos_embedding(position: Column, dim: int, base: float = 10000.0) -> Column:
    """``dim`` values: sines of ``position * base^(-i / (dim/2))``, then cosines."""
    half = dim // 2
    angles = [position * F.lit(base ** (-i / half)) for i in range(half)]
    return F.array(*(F.sin(a) for a in angles), *(F.cos(a) for a in angles))


def sincos_embedding_2d(row: Column, col: Column, dim: int) -> Column:
    """Half of the values for the column, half for the row."""
    return F.concat(sincos_embedding(col, dim // 2), sincos_embedding(row, dim // 2))


def timestep_embedding(t: Column, dim: int, max_period: float = 10000.0) -> Column:
    """Cosines, then sines of ``t * max_period^(-i / (dim/2))``."""
    half = dim // 2
    angles = [t * F.lit(max_period ** (-i / half)) for i in range(half)]
    return F.array(*(F.cos(a) for a in angles), *(F.sin(a) for a in angles))


def flow_time(x: Column, shift: float) -> Column:
    """Sigmoid, then ``s t / (1 + (s - 1) t)``."""
    t = 1 / (1 + F.exp(-x))
    return shift * t / (1 + (shift - 1) * t)


# --- patches ------------------------------------------------------------------


def patchified(values: Column, channels: Column, height: Column, width: Column, p: int) -> Column:
    """A (c, h, w) array in row-major order -> an array for each p x p patch, its values by row, column, channel."""
    rows, cols = F.floor(height / p).cast("int"), F.floor(width / p).cast("int")
    cells = lambda n: F.sequence(F.lit(0), n - 1)

    def patch(i: Column) -> Column:
        top, left = F.floor(i / cols).cast("int") * p, (i % cols) * p
        return F.transform(F.sequence(F.lit(0), channels * p * p - 1), lambda k: F.get(values, (k % channels) * height * width + (top + F.floor(k / channels / p).cast("int")) * width + left + F.floor(k / channels).cast("int") % p))

    return F.transform(cells(rows * cols), patch)


def patch_grid(height: Column, width: Column, size: int) -> Column:
    """struct(top, left, h, w) of each cell of a grid; the last row and column may be smaller."""
    ys, xs = F.sequence(F.lit(0), height - 1, F.lit(size)), F.sequence(F.lit(0), width - 1, F.lit(size))
    cell = lambda y, x: F.struct(y.alias("top"), x.alias("left"), F.least(F.lit(size), height - y).alias("h"), F.least(F.lit(size), width - x).alias("w"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: cell(y, x))))


def shuffled_cells(n: Column, seed: int, key: Column) -> Column:
    """The numbers below ``n`` in hash order: a permutation of patches."""
    from spindle.functions.det import digest

    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(digest(seed, "patch", key, i).alias("d"), i.alias("i")))), lambda x: x["i"])


def blank_cells(n: Column, share: float, seed: int, key: Column) -> Column:
    """The patches that are blanked: the first ``share`` of the hash order, ascending."""
    return F.array_sort(F.slice(shuffled_cells(n, seed, key), F.lit(1), F.floor(n * share).cast("int")))


# --- boxes ------------------------------------------------------------------------


def area(b: Column) -> Column:
    """Area of a box [x0, y0, x1, y1, ...] whose ends are inside it; 0 if it is empty."""
    return F.greatest(b[2] - b[0] + 1, F.lit(0.0)) * F.greatest(b[3] - b[1] + 1, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union with ends inside; 0 where the union is empty."""
    both = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1, F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1, F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def top_boxes(boxes: Column, threshold: float, k: int = 16) -> Column:
    """Up to ``k`` boxes [x0, y0, x1, y1, score] with a score above the threshold, best first."""
    good = F.filter(boxes, lambda b: b[4] > threshold)
    keyed = F.transform(good, lambda b: F.struct((-b[4]).alias("s"), b.alias("b")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["b"])


def suppressed(boxes: Column, overlap: float) -> Column:
    """Greedy non-maximum suppression of boxes that are best first: a box stays unless it overlaps one that stays."""
    empty = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, empty, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) >= overlap), kept).otherwise(F.concat(kept, F.array(b))))


def relative_position(a: Column, b: Column, margin: float = 0.1) -> Column:
    """Where box ``a`` is from box ``b``: any of left of / right of / above / below.

    The offset of centres, less ``margin`` times the summed sizes on each axis, is
    made a unit vector; an axis counts where it is above one half.
    """
    center = lambda x, i: (x[i] + x[i + 2]) / 2
    size = lambda x, i: F.abs(x[i + 2] - x[i])
    rest = []
    for i in (0, 1):
        d = center(a, i) - center(b, i)
        rest.append(F.greatest(F.abs(d) - margin * (size(a, i) + size(b, i)), F.lit(0.0)) * F.signum(d))
    norm = F.sqrt((center(a, 0) - center(b, 0)) ** 2 + (center(a, 1) - center(b, 1)) ** 2)
    dx, dy = (F.when(norm > 0, r / norm).otherwise(0.0) for r in rest)
    none = F.lit(None).cast("string")
    some = (rest[0] != 0) | (rest[1] != 0)
    named = F.array(F.when(dx < -0.5, "left of").otherwise(none), F.when(dx > 0.5, "right of").otherwise(none), F.when(dy < -0.5, "above").otherwise(none), F.when(dy > 0.5, "below").otherwise(none))
    return F.when(some, F.array_compact(named)).otherwise(F.array().cast("array<string>"))
