"""Model slots: models that stay in their Python worker, and calls on windows and on whole clusters.

A slot takes a list of items and returns as many replies, each a text or None. It is called with at most `batch` items;
where a call raises, each of its items is asked alone, and an item that fails alone has no reply.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import parse_choice, parse_reply
from tidemark.operators.incidents import clusters
from tidemark.sources import shared_folder

Slot = Callable[[list[dict]], list[str | None]]

#: What this Python process holds: for each role the key of its model and the model.
_held: dict[str, tuple[str, Any]] = {}


class Resident:
    """A model that each Python worker loads once, when it is first called there, from a file that executors fetch.

    The file's name is made of its content, so the same content is the same model in every job, and another
    content takes the place of the one that the role held before. Calling it calls the model.
    """

    def __init__(self, spark: SparkSession, content: bytes, load: Callable[[bytes], Callable], role: str = "model"):
        self.name, self.load, self.role = _hand_out(spark, content, role), load, role

    def __call__(self, *args: Any) -> Any:
        key, model = _held.get(self.role, (None, None))
        if key != self.name:
            _held.pop(self.role, None)  # the memory of the old one goes before the new one is loaded
            with open(SparkFiles.get(self.name), "rb") as file:
                model = self.load(file.read())
            _held[self.role] = (self.name, model)
        return model(*args)


def _hand_out(spark: SparkSession, content: bytes, stem: str) -> str:
    """Puts `content` into the shared folder, whole or not at all, for executors to fetch; its name there."""
    name = f"{stem}-{hashlib.sha256(content).hexdigest()[:24]}"
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    files = path.getFileSystem(settings)
    if not files.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(shared_folder(spark), f"{name}.{uuid.uuid4().hex}")
        out = files.create(part, True)
        for a in range(0, len(content), 1 << 20):
            out.write(bytearray(content[a : a + (1 << 20)]))
        out.close()
        if not files.rename(part, path):
            files.delete(part, False)
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def _called(slot: Slot, items: list[dict]) -> list[str | None]:
    try:
        replies = list(slot(items))
        if len(replies) != len(items):
            raise ValueError(f"{len(replies)} replies to {len(items)} items")
        return replies
    except Exception:  # noqa: BLE001  a model may fail in any way; that is no reply
        return [None] if len(items) == 1 else [r for item in items for r in _called(slot, [item])]


def ask(rows: DataFrame, slot: Slot, item: Column, batch: int = 16) -> DataFrame:
    """`rows` with reply, the slot's text on `item` (a struct), in calls of at most `batch` items."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            items = frame.to_dict("records")
            replies = [r for a in range(0, len(items), batch) for r in _called(slot, items[a : a + batch])]
            yield pd.Series(replies, index=frame.index, dtype=object)

    return rows.withColumn("reply", run.asNondeterministic()(item))  # else a later filter on the reply would call the model again


def pick(verdicts: DataFrame, slot: Slot, at: float, options: str = "options", batch: int = 16) -> DataFrame:
    """`verdicts` with second_class, second_confidence, second_description: the slot's choice for windows whose normal verdict the probe would override.

    Only those are asked, with event_id, options (the likeliest classes; none: not asked) and probe_anomaly. No reply, or
    normal, is no opinion: null, and the probe's own class stands.
    """
    due = (F.col("class") == "normal") & F.col("probe_top").isNotNull() & (F.col("probe_anomaly") >= at) & (F.size(options) > 0)
    due = F.coalesce(due, F.lit(False))
    said = parse_reply(F.col("reply"))
    asked = ask(verdicts.where(due), slot, F.struct("event_id", options, "probe_anomaly"), batch)
    chosen = F.col("reply").isNotNull() & (said["class"] != "normal")
    second = {"second_class": "class", "second_confidence": "confidence", "second_description": "description"}
    asked = asked.select(*verdicts.columns, *(F.when(chosen, said[c]).alias(n) for n, c in second.items()))
    rest = verdicts.where(~due).select("*", F.lit(None).cast("string").alias("second_class"), F.lit(None).cast("double").alias("second_confidence"), F.lit(None).cast("string").alias("second_description"))
    return asked.unionByName(rest)


def adjudicate(verdicts: DataFrame, slot: Slot, batch: int = 16) -> DataFrame:
    """video_id, cluster, primary, primary_confidence, primary_reason: the slot's decision on each cluster of several classes, for `incidents`.

    A cluster is one item, asked once: video_id, cluster and its observations, one of each class in the order of first sight
    (t0, class, confidence at its peak, description of the first window in 110 characters, n windows), so that an item is small
    however many windows a cluster has. A failed call or an unknown class leaves the cluster out, and its highest confidence decides.
    """
    seen = clusters(verdicts).groupBy("video_id", "cluster", "class").agg(F.min(F.struct("t0", "event_id", "description")).alias("first"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    observation = F.struct(F.col("first.t0").alias("t0"), F.col("first.event_id").alias("event_id"), "class", "confidence", F.substring(F.coalesce("first.description", F.lit("")), 1, 110).alias("description"), "n")
    items = seen.groupBy("video_id", "cluster").agg(F.array_sort(F.collect_list(observation)).alias("observations")).where(F.size("observations") > 1)
    # one class of an item is told as plain lists: a struct of arrays, which Arrow hands over without objects for each
    fields = [F.col("observations")[f].alias(f) for f in ("t0", "class", "confidence", "description", "n")]
    choice = parse_choice(F.col("reply"))
    asked = ask(items, slot, F.struct("video_id", "cluster", *fields), batch).withColumn("choice", choice)
    return asked.where("choice IS NOT NULL").select("video_id", "cluster", F.col("choice.primary").alias("primary"), F.col("choice.confidence").alias("primary_confidence"), F.col("choice.reason").alias("primary_reason"))
