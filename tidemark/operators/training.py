"""Training rows: a bounded sample of each class, joined to its vectors and pooled, as one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import similarity, windows


def _smallest(table: pa.Table, k: int) -> pa.Table:
    """The k rows of each class with the smallest (h, key), each once."""
    if not table.num_rows:
        return table
    table = table.group_by(["class_name", "h", "key"]).aggregate([]).sort_by([("class_name", "ascending"), ("h", "ascending"), ("key", "ascending")])
    names = table.column("class_name").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    turn = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
    return table.filter(pa.array(turn < k))


def bottom_k(rows: DataFrame, label: str, key: str, k: int, seed: int = 0, lanes: int = 64) -> DataFrame:
    """class_name, key: of each class the k keys (all, if fewer) with the smallest hash, the same in every run; a key counts once, nulls do not.

    The sample of a class is mergeable: that of two sets is the k smallest of both samples. So each task keeps k of each class from its own
    rows, `lanes` tasks of a class merge what they get, and one merges these; no task ever sorts a class.
    """
    h = F.unhex(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    schema = "class_name string, h binary, key long"
    hashed = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(label).cast("string").alias("class_name"), h.alias("h"), F.col(key).cast("long").alias("key"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = _smallest(table if kept is None else pa.concat_tables([kept, table]), k)
        if kept is not None:
            yield from kept.select(["class_name", "h", "key"]).to_batches()

    def merged(table: pa.Table) -> pa.Table:
        return _smallest(table.select(["class_name", "h", "key"]), k).select(["class_name", "h", "key"])

    own = hashed.mapInArrow(partial, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    return own.groupBy("class_name", "lane").applyInArrow(merged, schema).groupBy("class_name").applyInArrow(merged, schema).select("class_name", "key")


def training_rows(clips: DataFrame, disputed: DataFrame, frames: DataFrame, cap: int, k: int = 8, seed: int = 0) -> DataFrame:
    """video_id, class_name, n_frames, emb: the mean vector of at most k even frames of each chosen clip.

    clips: video_id, class_name, path, one row for each labelled clip. Clips in `disputed` (video_id) and clips without a class or path are left out,
    of the others at most `cap` of each class are chosen by hash. frames: video_id, event_id, t, emb; a clip without any has no row.
    A clip with several labels may stand for each. Vectors are read for the chosen frames only.
    """
    sound = clips.where("path IS NOT NULL AND class_name IS NOT NULL").join(disputed.select("video_id"), "video_id", "left_anti")
    chosen = bottom_k(sound, "class_name", "video_id", cap, seed).withColumnRenamed("key", "video_id")
    near = windows.pick(frames.select("video_id", "event_id", "t").join(chosen.select("video_id").distinct(), "video_id", "left_semi"), k, ("video_id",))
    vectors = near.select("video_id", "event_id").join(frames.select("video_id", "event_id", "emb"), ["video_id", "event_id"])
    pooled = similarity.mean_vector(vectors, "video_id").join(near.groupBy("video_id").agg(F.count("*").alias("n_frames")), "video_id")
    return chosen.join(pooled, "video_id").select("video_id", "class_name", "n_frames", F.col("mean").alias("emb"))
