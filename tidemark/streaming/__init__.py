"""The live path: scores, alerts, running statistics, the stateful gate, session and slot windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import Config
from tidemark.functions import rounded


def scores(stream: DataFrame) -> DataFrame:
    """Score messages: video_id, ts, t, health, anomaly to three places. stream: video_id, ts, t, health."""
    return stream.select("video_id", "ts", "t", rounded("health", 3).alias("health"), rounded(1 - F.col("health"), 3).alias("anomaly"))


def alerts(scored: DataFrame, at: float = 0.5, verified_at: float = 0.8) -> DataFrame:
    """Alert messages for anomalies above `at`; stage says whether the filter or the verifier would answer."""
    stage = F.when(F.col("anomaly") > verified_at, "vlm").otherwise("filter")
    return scored.where(F.col("anomaly") > at).select("video_id", "ts", "t", "anomaly", stage.alias("stage"))


def statistics(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """Running totals: frames_seen, frames_escalated, escalation_rate."""
    seen = scored.agg(F.count("*").alias("frames_seen"), F.count_if(F.col("anomaly") > at).alias("frames_escalated"))
    return seen.withColumn("escalation_rate", F.col("frames_escalated") / F.greatest("frames_seen", F.lit(1)))


def sessions(stream: DataFrame, threshold: float, gap: str, late: str = "1 minute") -> DataFrame:
    """Gap sessions of flagged frames: video_id, t0, t1, n_frames; t1 is the last frame's time, not the session's end."""
    flagged = stream.withWatermark("ts", late).where(F.col("health") < threshold)
    return flagged.groupBy("video_id", F.session_window("ts", gap)).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n_frames")).drop("session_window")


def slots(stream: DataFrame, step: str, late: str = "1 minute") -> DataFrame:
    """Tumbling scan slots: video_id, slot_start, n_frames, health."""
    by_slot = stream.withWatermark("ts", late).groupBy("video_id", F.window("ts", step))
    return by_slot.agg(F.count("*").alias("n_frames"), F.avg("health").alias("health")).select("video_id", F.col("window.start").alias("slot_start"), "n_frames", "health")


def centred(stream: DataFrame, span: str, step: str, half_seconds: int, late: str = "1 minute") -> DataFrame:
    """Sliding windows labelled by their centre: video_id, centre, health."""
    by_window = stream.withWatermark("ts", late).groupBy("video_id", F.window("ts", span, step))
    return by_window.agg(F.avg("health").alias("health")).select("video_id", (F.col("window.start") + F.expr(f"INTERVAL {half_seconds} SECONDS")).alias("centre"), "health")


class Gate(StatefulProcessor):
    """The motion gate on a stream: each video's last signal and last passed time are its state."""

    PART = 10_000  # rows that leave together

    def __init__(self, signal: float, keepalive: float):
        self.signal, self.keepalive = signal, keepalive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "before double, passed double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, passed = self.state.get() if self.state.exists() else (None, None)
        # rows come in any order: three numbers of each are held until all are there, what is made of them leaves in parts
        parts = [[pdf[c].to_numpy() for c in ("event_id", "t", "signal")] for pdf in rows]
        ids, times, signals = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        for a in range(0, len(order), self.PART):
            out = []
            for i in order[a : a + self.PART].tolist():
                t, signal = float(times[i]), float(signals[i])
                moved = 0.0 if before is None else abs(signal - before)
                why = "first" if passed is None else "motion" if moved >= self.signal else "keepalive" if t - passed >= self.keepalive else "skipped"
                before, passed = signal, passed if why == "skipped" else t
                out.append((key[0], int(ids[i]), t, moved, why))
            yield pd.DataFrame(out, columns=["video_id", "event_id", "t", "motion", "why"])
        self.state.update((before, passed))

    def close(self) -> None:
        pass


def gate(stream: DataFrame, config: Config) -> DataFrame:
    """The stateful gate; needs the RocksDB state store. Rows of a batch are taken in order of time.

    A task holds 24 bytes for each row of a video in a batch, which the source's limit of files or bytes for a trigger bounds.
    """
    return stream.select("video_id", "event_id", "t", "signal").groupBy("video_id").transformWithStateInPandas(
        Gate(config.gate_signal, config.gate_keepalive), "video_id long, event_id long, t double, motion double, why string", "Append", "None"
    )


def store(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes each micro-batch as Parquet to a folder of its own (batch=N), so that a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(stream: DataFrame, sinks: list, checkpoint: str):
    """Starts a query that hands each micro-batch to every sink; a sink that raises is dropped and the others go on."""
    alive = list(sinks)

    def fan_out(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in list(alive):
            try:
                sink(batch, number)
            except Exception:  # noqa: BLE001  a dead subscriber must not stop the stream
                alive.remove(sink)
        batch.unpersist()

    return stream.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
