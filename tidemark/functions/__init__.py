"""Column functions: all built from Spark expressions, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import CLASSES, LEAST_DURATION, LEAST_DURATION_ELSE, MARKS, MARKS_FLOOR


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def rounded(x: Column | str, places: int) -> Column:
    """`x` to so many decimal places as its binary value has it: the nearest, and of two equally near the even one.

    A product x * 10^places that ends in one half may only be rounded to it; the product's exact error (x in two parts, each
    short enough to be multiplied exactly) then decides. From 2^52 on there is no fraction left.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    scale = F.lit(float(10**places))
    product, part = x * scale, x * 134217729.0
    high = part - (part - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    whole = F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(product))
    return F.when(F.abs(product) < 2.0**52, whole / scale + 0.0).otherwise(x)


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def resolve_class(raw: Column) -> Column:
    """A free spelling to one of the twelve labels; anything unknown, and null, is normal."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "[- ]", "_"), "_+", "_"), F.lit("_"))
    squashed = F.element_at(_map({c.replace("_", ""): c for c in CLASSES}), F.regexp_replace(s, "_", ""))
    return F.when(s.isin(CLASSES), s).otherwise(F.coalesce(squashed, F.lit("normal")))


def parse_reply(text: Column) -> Column:
    """struct(class, confidence, description, parsed) of a model's reply: its outermost {...} as JSON, else the first label whose words occur in it."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "class STRING, confidence STRING, description STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    number = F.coalesce(got["confidence"], F.lit("0.0")).try_cast("double")
    # what stands in {...} must be one JSON value: Spark forgives what follows a value at the end, not inside another
    good = (body != "") & F.try_parse_json(F.concat(F.lit('{"v": '), body, F.lit("}"))).isNotNull() & got.isNotNull() & got["_bad"].isNull() & number.isNotNull()
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    words = F.array(*(F.lit(c) for c in CLASSES[1:]))
    hit = F.get(F.filter(words, lambda c: F.contains(F.lower(text), F.replace(c, F.lit("_"), F.lit(" ")))), F.lit(0))
    rescued = F.struct(
        F.coalesce(hit, F.lit("normal")).alias("class"),
        F.when(hit.isNotNull(), 0.4).otherwise(0.0).alias("confidence"),
        F.substring(F.trim(text), 1, 300).alias("description"),
        F.lit(False).alias("parsed"),
    )
    read = F.struct(
        resolve_class(got["class"]).alias("class"),
        clipped.alias("confidence"),
        F.substring(F.coalesce(got["description"], F.lit("")), 1, 300).alias("description"),
        F.lit(True).alias("parsed"),
    )
    return F.when(good, read).otherwise(rescued)


def parse_choice(text: Column) -> Column:
    """struct(primary, confidence, reason) of an adjudicator's reply, its outermost {...} as JSON; null where that is not an object or names no anomaly class.

    confidence is 0.5 where none is given, and the whole reply is void where it is no number.
    """
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "primary STRING, confidence STRING, reason STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = (body != "") & F.try_parse_json(F.concat(F.lit('{"v": '), body, F.lit("}"))).isNotNull() & got["_bad"].isNull()
    named, number = F.trim(got["primary"]), F.coalesce(got["confidence"], F.lit("0.5")).try_cast("double")
    choice = F.struct(named.alias("primary"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).alias("confidence"), F.substring(F.coalesce(got["reason"], F.lit("")), 1, 200).alias("reason"))
    return F.when(whole & named.isin(CLASSES[1:]) & number.isNotNull(), choice)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over hull of two intervals; 0 where the hull is empty."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, from left to right."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v.cast("array<double>"), lambda x: x / norm)).otherwise(v.cast("array<double>"))


def softmax(scores: Column, scale: float = 100.0) -> Column:
    """exp((s - max) * scale), divided by their sum."""
    e = F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) * scale))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def explanation(description: Column, others: Column) -> Column:
    """Description and the other classes seen; at most 500 characters, null if empty."""
    said = F.when(F.size(others) > 0, F.concat(F.lit("Also observed: "), F.array_join(F.transform(others, lambda c: F.replace(c, F.lit("_"), F.lit(" "))), ", "), F.lit(".")))
    return F.nullif(F.substring(F.trim(F.concat_ws(" ", description, said)), 1, 500), F.lit(""))


def least_duration(class_name: Column) -> Column:
    return F.coalesce(F.element_at(_map(LEAST_DURATION), class_name), F.lit(LEAST_DURATION_ELSE))


def marks(level: Column, found: Column, false_alarms: Column) -> Column:
    """Estimated marks of a level, between the floor and the level's cap."""
    out = None
    for number, (a, b, c, cap) in MARKS.items():
        value = F.greatest(F.lit(MARKS_FLOOR), F.least(F.lit(cap), F.lit(a) + F.lit(b) * found + F.lit(c) * F.log1p(false_alarms)))
        out = F.when(level == number, value) if out is None else out.when(level == number, value)
    return out


def bar(start: Column, end: Column, duration: Column, mark: str = "#", width: int = 46) -> Column:
    """One text row of `width` cells with the cells from start to end marked."""
    long = F.greatest(duration, F.lit(1e-6))

    def cell(t: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(width - 1), (F.lit(width) * t / long).cast("int")))

    first = cell(start)
    last = F.greatest(first, cell(end))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when((i >= first) & (i <= last), mark).otherwise(".")), "")


def crop_box(x: Column, y: Column, w: Column, h: Column, small: tuple[int, int], full: tuple[int, int], context: float = 3.0, least: float = 320.0) -> Column:
    """The crop (x0, y0, x1, y1) in full size around a box found in the small frame; null if under 32 pixels."""
    fx, fy = full[0] / small[0], full[1] / small[1]
    cx, cy = (x + w / 2) * fx, (y + h / 2) * fy
    half_w, half_h = (F.greatest(size * f * context, F.lit(least)) / 2 for size, f in ((w, fx), (h, fy)))
    x0, x1 = F.greatest(F.lit(0.0), cx - half_w).cast("int"), F.least(F.lit(float(full[0])), cx + half_w).cast("int")
    y0, y1 = F.greatest(F.lit(0.0), cy - half_h).cast("int"), F.least(F.lit(float(full[1])), cy + half_h).cast("int")
    return F.when((x1 - x0 >= 32) & (y1 - y0 >= 32), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def prompt_circle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Centre and radius of the marker around a box (integer centre)."""
    return F.struct(
        (x + F.floor(w / 2)).cast("int").alias("cx"), (y + F.floor(h / 2)).cast("int").alias("cy"), F.greatest(F.lit(18), (F.lit(0.6) * F.greatest(w, h)).cast("int")).alias("r")
    )


def clip_points(start: Column, end: Column, duration: Column, span: float = 16.0, n: int = 8) -> Column:
    """n even times over `span` around the labelled event, or around the middle without one; empty for no duration."""
    centre = F.coalesce((start + end) / 2, duration / 2)
    length = F.least(F.lit(span), duration)
    lo = F.greatest(F.lit(0.0), F.least(centre - length / 2, duration - length))
    hi = F.greatest(lo, F.least(duration, lo + length) - 1e-3)
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))
    return F.when(duration > 0, points).otherwise(F.array().cast("array<double>"))


def even_index(i: Column, n: Column, k: int) -> Column:
    """The i-th of k even positions among n (both from 0), halves to the even number."""
    return F.rint(i * (n - 1) / F.lit(k - 1)).cast("int")
