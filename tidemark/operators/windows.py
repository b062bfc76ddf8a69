"""Windows over frames: gap sessions, the scan floor, frame picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import even_index
from tidemark.operators import intervals


def escalations(frames: DataFrame, threshold: float, gap: float) -> DataFrame:
    """Flagged frames (health < threshold) with win: a new window begins after more than `gap` without one."""
    by_time = Window.partitionBy("video_id").orderBy("t", "event_id")
    new = (F.col("t") - F.lag("t").over(by_time) > gap).cast("int")
    flagged = frames.where(F.col("health") < threshold).withColumn("_new", F.coalesce(new, F.lit(0)))
    return flagged.withColumn("win", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def summarise(members: DataFrame, source: str) -> DataFrame:
    """One row for each window: video_id, source, win, t0, t1, n_frames, health."""
    return members.groupBy("video_id", "win").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n_frames"), F.avg("health").alias("health")).select(
        "video_id", F.lit(source).alias("source"), "win", "t0", "t1", "n_frames", "health"
    )


def scan_floor(frames: DataFrame, durations: DataFrame, threshold: float, config: Config) -> DataFrame:
    """Windows with guaranteed coverage: escalated ones, scans of uncovered slots, or a last resort.

    A slot [s, s + step) is covered if an escalated window begins before its end and ends at or after its
    start. A scan takes the frames nearest to the slot's centre; it counts if its first is within a step of it.
    Without any window, the frames of lowest health are the last resort. Videos no longer than
    floor_least get no scans.
    """
    k, step = config.frames_per_window, config.floor_step
    marked = summarise(escalations(frames, threshold, config.gap), "escalated")
    count = F.ceil(F.col("duration") / step)
    slots = durations.where(F.col("duration") > config.floor_least).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("slot"))
    covered = marked.select("video_id", F.explode(F.sequence(intervals.bucket("t0", step), intervals.bucket("t1", step))).alias("slot")).distinct()
    open_slots = slots.join(covered, ["video_id", "slot"], "left_anti").withColumn("centre", F.col("slot") * F.lit(step) + step / 2)
    # frames of videos without open slots are not numbered
    asked = frames.select("video_id", "t", "event_id", "health").join(open_slots.select("video_id").distinct(), "video_id", "left_semi")
    near = intervals.nearest(asked, open_slots, k, ["health"])
    scans = summarise(near.withColumnRenamed("slot", "win"), "scan")
    scans = scans.where(F.abs(F.col("t0") - (F.col("win") * F.lit(step) + step / 2)) <= step)
    found = marked.unionByName(scans)
    lowest = Window.partitionBy("video_id").orderBy("health", "t", "event_id")
    none = frames.join(found.select("video_id").distinct(), "video_id", "left_anti")
    low = none.withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= k).withColumn("win", F.lit(0).cast("long"))
    return found.unionByName(summarise(low, "last-resort"))


def pick(members: DataFrame, k: int, keys: tuple[str, ...] = ("video_id", "win")) -> DataFrame:
    """At most k frames of each window: all, or k even positions by time."""
    part = Window.partitionBy(*keys)
    n, i = F.count("*").over(part), F.row_number().over(part.orderBy("t", "event_id")) - 1
    ranked = members.withColumn("_n", n).withColumn("_i", i)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: even_index(j, F.col("_n"), k))
    return ranked.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i"))).drop("_n", "_i")


def widen(frames: DataFrame, centres: DataFrame, span: float, k: int) -> DataFrame:
    """Frames within span / 2 of each centre (video_id, centre_id, centre), at most k by even positions; centres with fewer than two are left out."""
    spans = centres.withColumns({"_lo": F.col("centre") - span / 2, "_hi": F.col("centre") + span / 2})
    near = intervals.points_in(frames, spans, "_lo", "_hi", span).drop("_lo", "_hi")
    some = near.withColumn("_m", F.count("*").over(Window.partitionBy("video_id", "centre_id"))).where("_m >= 2").drop("_m")
    return pick(some, k, ("video_id", "centre_id"))
