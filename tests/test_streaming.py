from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.queries import model


def test_stream_sessions_equal_the_batch_operator(spark, data):
    from tidemark import bindings
    from tidemark.config import BOUND
    from tidemark.operators import windows

    batch = windows.summarise(windows.escalations(bindings.frames(spark, data), 0.0, BOUND.gap), "escalated")
    want = sorted((r["video_id"], round(r["t0"], 6), round(r["t1"], 6), r["n_frames"]) for r in batch.collect())
    assert sorted(tuple(r) for r in model.stream_sessions(spark, data).collect()) == want


def test_centred_windows(spark, data):
    stream = model._stream(spark, data)
    got = model._drain(spark, streaming.centred(stream, "96 hours", "24 hours", 48 * 3600), "centred", "complete").collect()
    want = {}
    for r in spark.read.parquet(f"{data}/events.parquet").collect():
        day = r["ts"].replace(hour=0, minute=0, second=0, microsecond=0)
        for back in range(4):  # the four windows that hold the event, by their centres
            want.setdefault((r["user_id"], day + timedelta(days=2 - back)), []).append(1 - r["value"] / 50)
    mine = {(r["video_id"], r["centre"].replace(tzinfo=None)): r["health"] for r in got}
    assert len(mine) == len(got) and mine == pytest.approx({k: sum(v) / len(v) for k, v in want.items()})


def test_results_of_a_stream_are_files_and_repeat_themselves(spark, data, tmp_path):
    scored = streaming.scores(model._stream(spark, data))
    streaming.store(scored, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == n
    streaming.store(scored, str(tmp_path / "rows"), str(tmp_path / "again")).awaitTermination()  # the same batch once more
    assert spark.read.parquet(str(tmp_path / "rows")).count() == n


def test_fan_out_drops_dead_sinks(spark, data, tmp_path):
    got, calls = [], []

    def dead(batch, number):
        calls.append(number)
        raise ConnectionError("gone")

    query = streaming.publish(streaming.scores(model._stream(spark, data)), [dead, lambda batch, number: got.append(batch.count())], str(tmp_path / "c"))
    query.awaitTermination()
    assert sum(got) == spark.read.parquet(f"{data}/events.parquet").count() and len(calls) == 1
    assert query.lastProgress is not None


@pytest.mark.parametrize("at", [0.5])
def test_alerts_are_the_scores_above_the_threshold(spark, at):
    s = spark.createDataFrame([(1, 0.0, 0.2), (1, 1.0, 0.5), (1, 2.0, 0.1)], "video_id long, t double, health double").withColumn("ts", F.timestamp_seconds("t"))
    a = streaming.alerts(streaming.scores(s), at).orderBy("t").collect()
    assert [(r["t"], r["stage"]) for r in a] == [(0.0, "filter"), (2.0, "vlm")]
