"""Joins by time inside each video: points in spans, overlapping spans, the neighbours of a time.

Every join has the video and a time bucket as equal keys, so a long video is many small groups and never
all pairs. `width` is a bucket's length: about a typical span's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(t: Column | str, width: float) -> Column:
    return F.floor(F.col(t) / width if isinstance(t, str) else t / width)


def buckets(lo: str, hi: str, width: float) -> Column:
    """All buckets that [lo, hi] touches, as rows; none for an empty span."""
    return F.explode(F.when(F.col(lo) <= F.col(hi), F.sequence(bucket(lo, width), bucket(hi, width))))


def points_in(points: DataFrame, spans: DataFrame, lo: str, hi: str, width: float, t: str = "t") -> DataFrame:
    """Points (video_id, t, ...) joined with the spans (video_id, lo, hi, ...) that hold them, ends included."""
    a = points.withColumn("_bucket", bucket(t, width))
    b = spans.withColumn("_bucket", buckets(lo, hi, width))
    return a.join(b, ["video_id", "_bucket"]).where(F.col(t).between(F.col(lo), F.col(hi))).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], left: tuple[str, str], right: tuple[str, str], width: float) -> DataFrame:
    """Pairs of spans of equal `keys` that share more than an end; each pair once, in the first bucket that both touch."""
    x = a.withColumn("_bucket", buckets(*left, width))
    y = b.withColumn("_bucket", buckets(*right, width))
    both = x.join(y, [*keys, "_bucket"]).where((F.col(right[0]) < F.col(left[1])) & (F.col(right[1]) > F.col(left[0])))
    return both.where(F.col("_bucket") == F.greatest(bucket(left[0], width), bucket(right[0], width))).drop("_bucket")


def nearest(points: DataFrame, centres: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """For each centre (video_id, centre, ...) the k points nearest in time: ties by the earlier, then the smaller event_id.

    A centre's place among the points is found in one ordered pass; k points on either side of it are then
    taken by their number. points: video_id, t, event_id and `keep`.
    """
    forward = Window.partitionBy("video_id").orderBy("t", "event_id")
    backward = Window.partitionBy("video_id").orderBy("t", F.desc("event_id"))  # before a centre, ties prefer the smaller id too
    numbered = points.select("video_id", "t", "event_id", *keep, F.row_number().over(forward).alias("_after"), F.row_number().over(backward).alias("_before"))
    others = [c for c in centres.columns if c != "video_id"]
    merged = points.select("video_id", F.col("t").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(centres.select(F.struct(*others)).schema[0].dataType).alias("_c"))
    merged = merged.unionByName(centres.select("video_id", F.col("centre").alias("_at"), F.lit(1).alias("_kind"), F.struct(*others).alias("_c")))
    order = Window.partitionBy("video_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("_n", F.sum(1 - F.col("_kind")).over(order)).where("_kind = 1").select("video_id", "_n", "_c.*")
    step = F.explode(F.sequence(F.lit(1 - k), F.lit(k)))
    wanted = placed.withColumn("_step", step).withColumn("_i", F.col("_n") + F.col("_step"))
    mine = ["video_id", *others]
    before = wanted.where("_step <= 0").join(numbered.withColumnRenamed("_before", "_i").drop("_after"), ["video_id", "_i"])
    after = wanted.where("_step > 0").join(numbered.withColumnRenamed("_after", "_i").drop("_before"), ["video_id", "_i"])
    near = before.unionByName(after).withColumn("_d", F.abs(F.col("t") - F.col("centre")))
    best = Window.partitionBy(*mine).orderBy("_d", "t", "event_id")
    return near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_n", "_step", "_i", "_d", "_r")
