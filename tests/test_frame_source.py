"""The source of sampled frames: what it reads, and what it does not."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.operators import frames as fr
from tidemark.sources import frame_source as fs


@pytest.fixture
def folder(tmp_path):
    """Three videos of 2 x 2 cells at 10, 25 and an unknown rate, one without frames, and a file that is something else."""
    for name, rate, n in (("a", 10.0, 57), ("b", 25.0, 40), ("c", float("nan"), 30), ("none", 10.0, 0)):
        with open(tmp_path / f"{name}.frames", "wb") as f:
            f.write(struct.pack(fs.HEADER, fs.MAGIC, rate, 2, 2))
            for i in range(n):
                f.write(struct.pack("<4d", i, i + 0.25, i + 0.5, i + 0.75))
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def rows(df):
    return sorted((r["video_id"], r["frame"], r["sampled"], tuple(r["payload"])) for r in df.collect())


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters_give_the_same_rows_pushed_or_not(spark, folder, pushed):
    want = [(v, i, i % s == 0, (i, i + 0.25, i + 0.5, i + 0.75)) for v, n, s in (("a", 57, 5), ("b", 40, 12), ("c", 30, 12)) for i in range(n)]
    with sources.setting(spark, "spark.sql.python.filterPushdown.enabled", pushed):
        df = fs.read_frames(spark, folder, span=16)
        assert rows(df) == want
        assert rows(df.where("sampled")) == [w for w in want if w[2]]
        assert rows(df.where("sampled = false")) == [w for w in want if not w[2]]
        assert rows(df.where("sampled AND frame BETWEEN 10 AND 31 AND video_id = 'a'")) == [w for w in want if w[0] == "a" and w[2] and 10 <= w[1] <= 31]
        assert rows(df.where("t >= 1.0 AND t < 2.0 AND video_id IN ('b', 'c')")) == [w for w in want if w[0] in "bc" and 25 <= w[1] < 50]
        assert rows(df.where("video_id = 'z'")) == []


def test_skipped_frames_are_not_read(folder):
    reader = fs.FrameReader(folder, 2.0, 16)
    left = list(reader.pushFilters([fs.EqualTo(("sampled",), True), fs.GreaterThanOrEqual(("frame",), 20), fs.EqualTo(("video_id",), "a")]))
    assert [type(f).__name__ for f in left] == ["GreaterThanOrEqual", "EqualTo"]  # Spark checks these again, the first is done
    spans = reader.partitions()
    assert [(s.video, s.first, s.end) for s in spans] == [("a", 20, 36), ("a", 36, 52), ("a", 52, 57)]
    seeks = []

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.file.close()

        def seek(self, at):
            seeks.append((at - fs.HEADER_BYTES) // 32)
            return self.file.seek(at)

        def __getattr__(self, name):
            return getattr(self.file, name)

    class Store:
        def open_input_file(self, path):
            return Watched(store.open_input_file(path))

    store, plain = fs._store(folder)[0], fs._store
    fs._store = lambda f: (Store(), f)
    try:
        read = [i for s in spans for batch in reader.read(s) for i in batch.column("frame").to_pylist()]
    finally:
        fs._store = plain
    assert read == seeks == [20, 25, 30, 35, 40, 45, 50, 55]


def test_filter_is_pushed_in_the_plan(spark, folder):
    with sources.setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        plan = fs.read_frames(spark, folder).where("sampled")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan and "BatchScan tidemark_frames" in plan  # nothing is left to check


def test_durations_come_from_headers(spark, folder):
    assert {r["video_id"]: r["duration"] for r in fs.video_durations(spark, folder).collect()} == {"a": 5.7, "b": 1.6, "c": 1.2, "none": 0.0}
    with open(f"{folder}/bad.frames", "wb") as f:
        f.write(b"short")
    with pytest.raises(Exception, match="no container"):
        fs.video_durations(spark, folder).collect()


def test_equals_the_sampling_operator(spark, data, tmp_path):
    from tidemark import bindings as B

    f = B.frames(spark, data)
    fs.write_containers(f.select("video_id", "t", "event_id", F.col("signal").alias("value")), str(tmp_path))
    assert all(x.endswith(".frames") for x in os.listdir(tmp_path))
    got = fs.read_frames(spark, str(tmp_path)).where("sampled").select(F.col("video_id").cast("long"), F.element_at("payload", 1).alias("value"))
    want = fr.sample(f.withColumn("source_rate", F.lit(10.0)), 2.0).select("video_id", F.col("signal").alias("value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_small_containers_share_partitions(spark, tmp_path):
    """Before, every container was opened to plan the read and had a partition of its own."""
    for i in range(200):
        with open(tmp_path / f"{i}.frames", "wb") as f:
            f.write(struct.pack(fs.HEADER, fs.MAGIC, 10.0, 1, 2))
            f.write(struct.pack(f"<{2 * (i % 13)}d", *(i + j / 4 for j in range(2 * (i % 13)))))
    assert len(fs.FrameReader(str(tmp_path), 2.0, 4096).partitions()) == 7
    want = [(str(i), j, j % 5 == 0, (i + j / 2, i + j / 2 + 0.25)) for i in range(200) for j in range(i % 13)]
    for pushed in ("true", "false"):
        with sources.setting(spark, "spark.sql.python.filterPushdown.enabled", pushed):
            df = fs.read_frames(spark, str(tmp_path))
            assert rows(df) == sorted(want)
            assert rows(df.where("sampled AND frame BETWEEN 3 AND 9")) == sorted(w for w in want if w[2] and 3 <= w[1] <= 9)
            assert rows(df.where("t > 0.25 AND t < 0.7 AND video_id IN ('12', '25', '13')")) == sorted(w for w in want if w[0] in ("12", "25") and 3 <= w[1] <= 6)
    assert {r["video_id"]: r["duration"] for r in fs.video_durations(spark, str(tmp_path)).collect()} == {str(i): (i % 13) / 10 for i in range(200)}
