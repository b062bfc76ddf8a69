"""Live figures and fan-out: restarts, repeated batches, dead subscribers."""

import glob
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.streaming import fanout, progress

SCHEMA = "video_id long, ts timestamp, t double, health double"


def scores(spark, folder):
    return streaming.scores(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))


def add(spark, folder, first, n):
    """A further file of the stream: n frames, every third of them with an anomaly of 0.75."""
    i = F.col("id")
    spark.range(first, first + n, 1, 1).select((i % 4).alias("video_id"), F.timestamp_seconds(i).alias("ts"), i.cast("double").alias("t"), F.when(i % 3 == 0, 0.25).otherwise(0.875).alias("health")).write.mode("append").parquet(folder)


def forget_last_commit(state):
    """As if the driver had been lost after the last batch was done, before Spark knew: it runs again."""
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{state}/commits/[0-9]*"))
    for p in glob.glob(f"{state}/commits/{last}") + glob.glob(f"{state}/commits/.{last}.crc"):
        os.remove(p)
    return last


def test_progress_of_a_restarted_stream_counts_no_batch_twice(spark, tmp_path):
    at = str(tmp_path)
    add(spark, f"{at}/in", 0, 25)
    add(spark, f"{at}/in", 25, 8)

    def run():
        streaming.store(progress.observed(scores(spark, f"{at}/in")), f"{at}/out", f"{at}/state").awaitTermination()

    progress.watched(spark, f"{at}/progress", run)
    first = progress.totals(spark, f"{at}/progress").orderBy("batch").collect()
    assert [r["frames_seen"] for r in first] in ([25, 33], [8, 33]) and all(r["due"] for r in first if r["frames_seen"] != 8)
    forget_last_commit(f"{at}/state")
    add(spark, f"{at}/in", 33, 4)
    progress.watched(spark, f"{at}/progress", run)
    rows = progress.totals(spark, f"{at}/progress").orderBy("batch").collect()
    last = rows[-1]
    assert len(rows) == 3 and len({r["query"] for r in rows}) == 1
    assert (last["frames_seen"], last["frames_escalated"], last["escalation_rate"], last["footage"], last["due"]) == (37, 13, round(13 / 37, 4), 36.0, False)
    assert last["seconds"] > 0 and last["realtime_factor"] == round(36.0 / last["seconds"], 2)
    assert spark.read.parquet(f"{at}/out").count() == 37


def test_running_totals_in_update_mode(spark, tmp_path):
    at = str(tmp_path)
    add(spark, f"{at}/in", 0, 25)
    add(spark, f"{at}/in", 25, 8)
    streaming.store(streaming.statistics(scores(spark, f"{at}/in")), f"{at}/out", f"{at}/state", "update").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{at}/out").select("frames_seen", "frames_escalated").collect())
    assert got[-1] == (33, 11) and len(got) == 2


@pytest.fixture
def logged(spark, tmp_path):
    """A log of two batches, and what runs the stream again."""
    at = str(tmp_path)
    add(spark, f"{at}/in", 0, 10)
    add(spark, f"{at}/in", 10, 5)

    def run():
        fanout.log(scores(spark, f"{at}/in").select("t", "anomaly"), f"{at}/log", f"{at}/state").awaitTermination()

    run()
    return at, run


def numbers(spark, at):
    rows = fanout.messages(spark, f"{at}/log").orderBy("batch", "place").collect()
    assert len({(r["batch"], r["place"]) for r in rows}) == len(rows)
    return sorted(json.loads(r["message"])["data"]["t"] for r in rows)


def test_a_batch_that_runs_again_neither_loses_nor_repeats_messages(spark, logged):
    at, run = logged
    assert numbers(spark, at) == list(range(15))
    parts = set(os.listdir(f"{at}/log/parts"))
    forget_last_commit(f"{at}/state")
    open(f"{at}/log/parts/of-a-lost-task", "w").close()  # never committed, never read
    add(spark, f"{at}/in", 15, 6)
    run()
    assert numbers(spark, at) == list(range(21)) and not parts <= set(os.listdir(f"{at}/log/parts"))


def test_each_subscriber_has_every_message_once_over_restarts(spark, logged):
    at, run = logged
    got, few = [], []
    assert fanout.FanOut(f"{at}/log").deliver({"a": got.extend, "b": lambda m: few.append(len(m))}, most=4) == {"a": 15, "b": 15}
    assert max(few) <= 4 and sum(few) == 15 and all(m["type"] == "score" for m in got)
    forget_last_commit(f"{at}/state")
    add(spark, f"{at}/in", 15, 6)
    run()
    late = []
    assert fanout.FanOut(f"{at}/log").deliver({"a": got.extend, "late": late.extend}) == {"a": 6, "late": 21}
    assert sorted(m["data"]["t"] for m in got) == sorted(m["data"]["t"] for m in late) == list(range(21))
    assert fanout.FanOut(f"{at}/log").deliver({"a": got.extend}) == {"a": 0}


def test_dead_subscribers_stay_evicted_until_admitted(spark, logged):
    at, _ = logged
    got, calls, after = [], [], []

    def dies(m):
        calls.append(m)
        if len(calls) > 1:
            raise ConnectionError("gone")

    f = fanout.FanOut(f"{at}/log")
    took = f.deliver({"dies": dies, "lives": got.extend})
    assert took["lives"] == 15 and len(got) == 15 and took["dies"] in (5, 10)
    assert fanout.FanOut(f"{at}/log").state("dies")["dead"] == "ConnectionError('gone')"
    assert fanout.FanOut(f"{at}/log").deliver({"dies": after.extend}) == {"dies": 0} and not after
    f.admit("dies")
    assert f.deliver({"dies": after.extend})["dies"] == 15 - took["dies"] == len(after)
    assert not {(m["batch"], m["place"]) for m in calls[0]} & {(m["batch"], m["place"]) for m in after}


def test_aborted_parts_go(tmp_path):
    w = fanout.LogWriter(str(tmp_path))
    part = w.write(iter([{"message": "x"}]))
    empty = w.write(iter([]))
    w.abort([part, None], 0)
    w.commit([empty, None], 0)
    assert os.listdir(tmp_path / "parts") == [] and fanout._batches(*fanout._store(str(tmp_path))) == [0]
    shutil.rmtree(tmp_path)
