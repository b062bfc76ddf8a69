"""Whole plans: from frames to incidents in one shuffle on video_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import incidents


def curves(frames: DataFrame) -> DataFrame:
    """video_id, t, event_id, health: the health curve, a row for each sample."""
    return frames.select("video_id", "t", "event_id", "health")


def durations(frames: DataFrame, tail: float = 1.0) -> DataFrame:
    """video_id, duration: the last frame's time and one frame more."""
    return frames.groupBy("video_id").agg((F.max("t") + tail).alias("duration"))


def timeline(incidents: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of a video's timeline: video_id, kind (bar, marker, band), class_name, start, length, measured.

    A bar for each incident, measured or not; a marker where each of its other classes was first seen; a band
    for each labelled interval (video_id, class, s, e).
    """
    none = F.lit(None)
    bars = incidents.select("video_id", F.lit("bar").alias("kind"), "class_name", "start", (F.col("end") - F.col("start")).alias("length"), F.startswith("source", F.lit("measured")).alias("measured"))
    tags = incidents.select("video_id", F.explode("sub_tags").alias("s")).select("video_id", F.lit("marker").alias("kind"), "s.class_name", F.col("s.first_seen_sec").alias("start"), none.cast("double").alias("length"), none.cast("boolean").alias("measured"))
    bands = truth.where("s is not null").select("video_id", F.lit("band").alias("kind"), F.col("class").alias("class_name"), F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("length"), none.cast("boolean").alias("measured"))
    return bars.unionByName(tags).unionByName(bands)


#: Rows of one input that a task takes, about: videos are dealt out by that, so that its memory does not grow with the tables.
ROWS = 100_000


def measured_incidents(frames: DataFrame, verdicts: DataFrame, config: Config) -> DataFrame:
    """Incidents whose extent follows the health curve and ends with the video."""
    tasks = max(frames.sparkSession.sparkContext.defaultParallelism, frames.count() // ROWS + 1, verdicts.count() // ROWS + 1)
    frames, verdicts = frames.repartition(tasks, "video_id"), verdicts.repartition(tasks, "video_id")
    return incidents.incidents(verdicts, config, curves(frames), durations(frames))
