"""Frame choice: indices of a video's frames as arrays, from its length alone and a uniform number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.det import let, uniform


def all_frames(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def first_frame() -> Column:
    return F.array(F.lit(0))


def _strided(start: Column, length: Column, stride: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: (start + i * stride).cast("int"))


def _choice(stride: Column, length: Column, start: Column) -> Column:
    return F.struct(stride.alias("stride"), length.alias("length"), start.alias("start"), _strided(start, length, stride).alias("indices"))


def adaptive(n: Column, lengths: list[int], strides: list[int], u_stride: Column, u_start: Column, clip: str = "uniform", jitter: Column | float = 0.0) -> Column:
    """struct(stride, length, start, indices): a feasible stride (each as likely), the longest length that fits, then a place.

    ``clip``: ``center`` (half of the room, rounded to even, plus ``jitter``) or ``uniform``.
    Null where no stride is feasible.
    """
    def places(n: Column, stride: Column, length: Column) -> Column:
        room = n - 1 - stride * (length - 1)
        start = F.rint(room / 2.0) + jitter if clip == "center" else F.floor(u_start * (room + 1))
        return let(F.greatest(F.lit(0), F.least(start.cast("int"), room.cast("int"))), lambda start: _choice(stride, length, start))

    def by_length(n: Column, stride: Column) -> Column:
        return let(F.array_max(F.filter(F.array(*map(F.lit, lengths)), lambda x: F.floor(n / stride) >= x)), lambda length: places(n, stride, length))

    def by_stride(n: Column, feasible: Column) -> Column:
        stride = F.get(feasible, F.floor(u_stride * F.size(feasible)).cast("int"))
        return F.when(F.size(feasible) > 0, let(stride, lambda stride: by_length(n, stride)))

    return let(n, lambda n: let(F.filter(F.array(*map(F.lit, strides)), lambda s: F.floor(n / s) >= min(lengths)), lambda feasible: by_stride(n, feasible)))


@dataclass(frozen=True)
class Strategy:
    """Frame lengths of one stride and their probabilities: ``uniform``, ``harmonic`` (longest first) or a list."""

    stride: int
    lengths: tuple[int, ...]
    stride_prob: float = 1.0
    lengths_prob: str | tuple[float, ...] = "uniform"

    def weights(self) -> list[tuple[int, float]]:
        n = len(self.lengths)
        if self.lengths_prob == "uniform":
            return [(x, 1.0 / n) for x in sorted(self.lengths)]
        if self.lengths_prob == "harmonic":
            return list(zip(sorted(self.lengths), [1.0 / (n - i) for i in range(n)], strict=True))
        return sorted(zip(self.lengths, self.lengths_prob, strict=True))


def _pick(options: list[tuple[int, float, Column]], u: Column) -> Column:
    """The value that ``u`` falls on; infeasible ones come last and give their share to the last feasible one."""
    total = sum(w for _, w, _ in options)
    run, out = 0.0, F.lit(None).cast("int")
    cuts = []
    for v, w, ok in options:
        run += w / total
        cuts.append((v, run, ok))
    for k in range(len(cuts) - 1, -1, -1):
        v, cut, ok = cuts[k]
        last = ~cuts[k + 1][2] if k + 1 < len(cuts) else F.lit(True)
        out = F.when(ok & ((u < cut) | last), v).otherwise(out)
    return out


def advanced(n: Column, strategies: list[Strategy], u_stride: Column, u_length: Column, u_start: Column, clip: str = "uniform", offset: Column | int = 0) -> Column:
    """struct(stride, length, start, indices) by strategies; ``clip``: uniform, center or simple (the first strategy at ``offset``).

    All places count from ``offset``.  Null where no strategy is feasible.
    """
    ordered = sorted(strategies, key=lambda s: s.stride)
    if clip == "simple":
        stride, length = F.lit(ordered[0].stride), F.lit(min(ordered[0].lengths))
        start = F.lit(offset) if isinstance(offset, int) else offset
        return let(start.cast("int"), lambda start: _choice(stride, length, start))

    def places(n: Column, stride: Column, length: Column) -> Column:
        room = n - 1 - stride * (length - 1)
        start = (F.rint(room / 2.0) if clip == "center" else F.floor(u_start * (room + 1))).cast("int") + offset
        return let(start, lambda start: _choice(stride, length, start))

    def by_length(n: Column, stride: Column, u: Column) -> Column:
        length = F.lit(None).cast("int")
        for s in ordered:
            length = F.when(stride == s.stride, _pick([(x, w, F.floor(n / s.stride) >= x) for x, w in s.weights()], u)).otherwise(length)
        return let(length, lambda length: places(n, stride, length))

    def by_stride(n: Column, u: Column) -> Column:
        stride = _pick([(s.stride, s.stride_prob, F.floor(n / s.stride) >= min(s.lengths)) for s in ordered], u)
        return let(stride, lambda stride: F.when(stride.isNotNull(), let(u_length, lambda v: by_length(n, stride, v))))

    return let(n, lambda n: let(u_stride, lambda u: by_stride(n, u)))


def _interval(n: Column, m: Column, i: Column) -> Column:
    """Start of interval ``i`` of ``m`` equal ones over ``n`` frames."""
    return F.floor(i * (n.cast("double") / m)).cast("int")


def interval_frames(n: Column, want: int, mode: str = "middle", fix_start: int | None = None, u: Column | None = None) -> Column:
    """One frame of each of min(want, n) equal intervals: its middle, its start plus ``fix_start``, or by ``u``; the last is repeated up to ``want``."""
    m = F.least(F.lit(want), n)

    def one(i: Column) -> Column:
        low, high = _interval(n, m, i), F.when(i + 1 == m, n).otherwise(_interval(n, m, i + 1)) - 1
        if mode == "rand":
            return (low + F.floor(u * (high - low + 1))).cast("int")
        return (low + fix_start if fix_start is not None else F.floor((low + high) / 2)).cast("int")

    frames = F.transform(F.sequence(F.lit(0), m - 1), one)
    return F.when(n > 0, F.concat(frames, F.array_repeat(F.element_at(frames, -1), F.lit(want) - m)))


def fps_frames(n: Column, fps: float, input_fps: float = 1.0, at_most: int = -1) -> Column:
    """Frames at the middles of 1/fps steps, rounded to even, that the video has; the first ``at_most``."""
    delta = 1.0 / fps
    steps = F.ceil((n / input_fps) / delta).cast("int")
    times = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), lambda i: F.rint((delta / 2 + i * delta) * input_fps).cast("int"))
    frames = F.filter(times, lambda f: f < n)
    return F.slice(frames, 1, at_most) if at_most > 0 else frames


def spaced(start: Column, stop: Column, count: Column | int) -> Column:
    """``count`` whole numbers evenly from start to stop, rounded down."""
    k = F.lit(count) if isinstance(count, int) else count
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k > 1, F.floor(start + i * ((stop - start).cast("double") / F.greatest(k - 1, F.lit(1))))).otherwise(start).cast("int"))


def long_enough(n: Column, want: int, stride: int, skip: int) -> Column:
    return (want - 1) * stride + 1 <= n - 2 * skip


def clip_frames(n: Column, want: int, stride: int, skip: int, u: Column) -> Column:
    """``want`` frames of a strided clip that leaves ``skip`` frames at both ends; null where the video is too short."""
    length = F.least(n, F.lit((want - 1) * stride + 1))
    start = skip + F.floor(u * (n - length - 2 * skip + 1))
    return F.when(long_enough(n, want, stride, skip), spaced(start, start + length - 1, want))


def window_start(begin: Column, end: Column, frames: int, u: Column) -> Column:
    """A start between ``begin`` and the last place, at least 0, that leaves ``frames`` and one more before ``end``."""
    last = F.greatest(F.lit(0), end - frames - 1)
    return F.when(last <= begin, F.least(begin, last)).otherwise(begin + F.floor(u * (last - begin + 1))).cast("int")


def keyframe_of(frame: Column, keyframes: Column) -> Column:
    """Number of the last keyframe before a frame, the first one for earlier frames."""
    return F.greatest(F.size(F.filter(keyframes, lambda k: k < frame)) - 1, F.lit(0))


def keyframe_plan(frames: Column, keyframes: Column) -> Column:
    """Frames in order as struct(frame, keyframe, seek, place): seek where the keyframe changes, place as asked for."""
    placed = F.array_sort(F.transform(frames, lambda f, i: F.struct(f.alias("frame"), i.alias("place"))))
    known = F.transform(placed, lambda x: F.struct(x["frame"].alias("frame"), keyframe_of(x["frame"], keyframes).alias("keyframe"), x["place"].alias("place")))
    return F.transform(
        known,
        lambda x, i: F.struct(x["frame"].alias("frame"), x["keyframe"].alias("keyframe"), ((i == 0) | (x["keyframe"] != F.get(known, F.greatest(i - 1, F.lit(0)))["keyframe"])).alias("seek"), x["place"].alias("place")),
    )


def frame_number(name: Column) -> Column:
    """The number before ``.jpg`` after the last underscore, else -1."""
    found = F.regexp_extract(name, r"_(\d+)\.jpg$", 1)
    return F.when(found != "", found.cast("int")).otherwise(-1)


def is_folder(path: Column) -> Column:
    return path.endswith("/")


def integer_parts(total: Column, seed: int, key: Column, decay: float = 1.0) -> Column:
    """A random partition of ``total`` into ordered parts: their number is uniform, or falls by ``decay`` from one; cuts are distinct places."""
    u = uniform(seed, "parts", key)
    if decay == 1.0:
        n = 1 + F.floor(u * total)
    else:  # inverse of a truncated geometric distribution
        n = 1 + F.floor(F.log(1 - u * (1 - F.pow(F.lit(decay), total))) / F.log(F.lit(decay)))
    n = F.least(n, total).cast("int")
    places = F.when(total > 1, F.sequence(F.lit(1), F.greatest(total - 1, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    ordered = F.array_sort(F.transform(places, lambda i: F.struct(uniform(seed, "cut", key, i).alias("u"), i.alias("i"))))
    cuts = F.concat(F.array_sort(F.transform(F.slice(ordered, F.lit(1), n - 1), lambda x: x["i"])), F.array(total.cast("int")))
    return let(cuts, lambda cuts: F.transform(cuts, lambda c, i: c - F.when(i > 0, F.get(cuts, F.greatest(i - 1, F.lit(0)))).otherwise(0)))


# --- caption choice ---------------------------------------------------------------------


def all_keys(texts: Column, allowed: list[str] | None = None) -> Column:
    """Keys of a map of captions; of an allow-list, those there are, in its order."""
    keys = F.map_keys(texts)
    return F.array_intersect(F.array(*map(F.lit, allowed)), keys) if allowed else keys


def by_priority(keys: Column, priority: list[str], u: Column) -> Column:
    """The first priority key there is, else any key."""
    first = F.get(F.filter(F.array(*map(F.lit, priority)), lambda k: F.array_contains(keys, k)), 0)
    return F.coalesce(first, F.get(keys, F.floor(u * F.size(keys)).cast("int")))


def pattern_of(key: Column, patterns: list[str]) -> Column:
    """Number of the first pattern that matches a key from its start, else null."""
    out = F.lit(None).cast("int")
    for i in range(len(patterns) - 1, -1, -1):
        out = F.when(key.rlike(f"^(?:{patterns[i]})"), i).otherwise(out)
    return out


def by_frequency(keys: Column, weights: dict[str, float], u: Column) -> Column:
    """A key by weight: each pattern's weight is shared by the keys it is the first to match; null if all weights are 0."""
    patterns, values = list(weights), F.array(*(F.lit(float(w)) for w in weights.values()))
    matched = F.transform(keys, lambda k: F.struct(k.alias("k"), pattern_of(k, patterns).alias("p")))
    shared = F.transform(matched, lambda m: F.struct(m["k"].alias("k"), F.coalesce(F.get(values, m["p"]) / F.size(F.filter(matched, lambda o: o["p"] == m["p"])), F.lit(0.0)).alias("w")))
    total = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x["w"])
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("string").alias("k"))
    walked = F.aggregate(
        shared,
        start,
        lambda s, x: F.struct((s["run"] + x["w"]).alias("run"), F.when(s["k"].isNull() & (x["w"] > 0) & (u * total < s["run"] + x["w"]), x["k"]).otherwise(s["k"]).alias("k")),
    )
    return F.when(total > 0, walked["k"])


def by_skip(texts: Column, keys: list[str], ratios: list[float], u: Column) -> Column:
    """The first key that is not skipped with its ratio; the last key otherwise.  One ``u`` serves all keys."""
    out = F.try_element_at(texts, F.lit(keys[-1]))
    for i in range(len(ratios) - 1, -1, -1):
        k, r = keys[i], ratios[i]
        out = F.when((u >= r) & F.try_element_at(texts, F.lit(k)).isNotNull(), F.try_element_at(texts, F.lit(k))).otherwise(out)
    return out


def english_caption(texts: Column, u: Column) -> Column:
    """Any value whose key has ``_en_`` and ``_text``."""
    found = F.map_values(F.map_filter(texts, lambda k, _: k.contains("_en_") & k.contains("_text")))
    return F.get(found, F.floor(u * F.size(found)).cast("int"))


def alternate(captions: Column, p: float, u: Column) -> Column:
    """The second caption with probability ``p`` where there is one, else the first."""
    return F.when((F.size(captions) > 1) & (u < p), F.get(captions, 1)).otherwise(F.get(captions, 0))


def edit_pair(images: Column, instructions: Column, u_start: Column, u_end: Column, u_join: Column, u_text: Column) -> Column:
    """struct(start, end, joined, texts): a start image, an end at most two on, and an instruction for each step.

    With probability one half the steps of a longer pair are joined into one
    instruction (one step fewer at the end of the list).
    """
    start = F.floor(u_start * (images - 1)).cast("int")
    last = F.least(start + 3, images)
    end = (start + 1 + F.floor(u_end * (last - start - 1))).cast("int")
    joined = (end - start > 1) & (u_join < 0.5)
    end = F.when(joined & (end == images - 1), end - 1).otherwise(end)
    pick = lambda i: F.get(F.get(instructions, i - 1), F.floor(u_text * F.size(F.get(instructions, i - 1))).cast("int"))
    steps = F.transform(F.sequence(start + 1, end), pick)
    texts = F.when(joined, F.array(F.rtrim(F.array_join(F.transform(steps, lambda s: F.concat(s, F.lit(". "))), "")))).otherwise(steps)
    return F.struct(start.alias("start"), end.alias("end"), joined.alias("joined"), texts.alias("texts"))
