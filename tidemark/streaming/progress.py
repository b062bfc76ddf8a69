"""Live figures of a stream: what each micro-batch observes, and running totals that a restart does not count twice."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions import rounded

OBSERVED = "live"


def observed(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """`scored` (t, anomaly) as it is, with what each micro-batch holds observed on the way: no further pass, no shuffle."""
    return scored.observe(OBSERVED, F.count("*").alias("frames"), F.count_if(F.col("anomaly") > at).alias("escalated"), F.min("t").alias("first"), F.max("t").alias("last"))


class Progress(StreamingQueryListener):
    """Writes a row for each micro-batch, under the query's id and the batch's number: a batch that runs again replaces its row.

    The id is that of the stream's checkpoint, so rows of a restarted query go on where the last run ended. Files are JSON in `folder`, of any
    store that Spark reads.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        if seen is None or not seen["frames"]:
            return
        row = {"query": str(p.id), "batch": p.batchId, "frames": seen["frames"], "escalated": seen["escalated"], "first": seen["first"], "last": seen["last"], "seconds": p.durationMs.get("triggerExecution", 0) / 1000}
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder, f"{p.id}-{p.batchId:012d}.json")
        part = jvm.org.apache.hadoop.fs.Path(self.folder, f".{uuid.uuid4().hex}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(part, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        files.delete(path, False)
        files.rename(part, path)


def watched(spark: SparkSession, folder: str, run) -> None:
    """Calls `run`, which starts streams and waits for them, with a listener that writes progress rows to `folder`; returns when the last is written."""
    listener = Progress(spark, folder)
    spark.streams.addListener(listener)
    try:
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)


def totals(spark: SparkSession, folder: str, every: int = 10) -> DataFrame:
    """query, batch, frames_seen, frames_escalated, escalation_rate (4 places), footage, seconds, realtime_factor (2 places), due.

    A row for each micro-batch with the sums up to it, few rows for a query. footage: the time from the first frame to the last; realtime_factor: footage
    for each second taken, 0 where none was; due: whether the frames seen have passed a multiple of `every`, when statistics are sent.
    """
    kind = "query string, batch long, frames long, escalated long, first double, last double, seconds double"
    order = Window.partitionBy("query").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    seen, escalated, seconds = (F.sum(c).over(order) for c in ("frames", "escalated", "seconds"))
    footage = F.max("last").over(order) - F.min("first").over(order)
    rows = spark.read.schema(kind).json(folder).select("query", "batch", "frames", seen.alias("frames_seen"), escalated.alias("frames_escalated"), footage.alias("footage"), seconds.alias("seconds"))
    due = F.floor(F.col("frames_seen") / every) > F.floor((F.col("frames_seen") - F.col("frames")) / every)
    return rows.select(
        "query", "batch", "frames_seen", "frames_escalated", rounded(F.col("frames_escalated") / F.greatest("frames_seen", F.lit(1)), 4).alias("escalation_rate"), "footage", "seconds",
        F.when(F.col("seconds") > 0, rounded(F.col("footage") / F.col("seconds"), 2)).otherwise(F.lit(0.0)).alias("realtime_factor"), due.alias("due"),
    )
