"""From windows to verdict rows: what a verifier says about each window, the probe's second opinion, the record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import parse_reply
from tidemark.operators import windows


def records(members: DataFrame, config: Config, rate: float, keys: tuple[str, ...] = ("video_id", "win")) -> DataFrame:
    """One row for each window of `members` (video_id, win, t, event_id, health): t0, t1, n_frames, picked, health, first_event.

    t0 and t1 are the whole window's, to the end of its last frame (`rate` frames in a unit of time); health is the mean of
    the at most frames_per_window frames that a verifier would see.
    """
    whole = members.groupBy(*keys).agg(F.min("t").alias("t0"), (F.max("t") + 1 / rate).alias("t1"), F.count("*").alias("n_frames"), F.min(F.struct("t", "event_id"))["event_id"].alias("first_event"))
    seen = windows.pick(members, config.frames_per_window, keys).groupBy(*keys).agg(F.count("*").alias("picked"), F.avg("health").alias("health"))
    return whole.join(seen, list(keys))


def judged(records: DataFrame) -> DataFrame:
    """`records` with a reply as verdicts: class, confidence, description; a window without a reply (its verifier failed) is dropped."""
    said = parse_reply(F.col("reply"))
    return records.where("reply is not null").withColumns({"class": said["class"], "confidence": said["confidence"], "description": said["description"]}).drop("reply")


def stage1(frames: DataFrame, rules: DataFrame, target: float, encoder) -> DataFrame:
    """Sample, embed, normalise, score: frame_id, video_id, t, emb (length 1), health. frames: video_id, event_id, t, payload, source_rate."""
    from tidemark.functions import l2_normalise
    from tidemark.operators import frames as fr
    from tidemark.operators import probe, similarity

    sampled = fr.sample(frames, target).withColumnRenamed("event_id", "frame_id")
    vectors = probe.embed(sampled, encoder).withColumn("emb", l2_normalise(F.col("emb"))).select("frame_id", "video_id", "t", "emb")
    return vectors.join(similarity.health(vectors, rules), "frame_id")
