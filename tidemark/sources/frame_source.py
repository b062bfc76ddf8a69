"""Frames of raw containers as a Spark data source that reads only what is asked for.

A container is one file of one video: a header (magic, rate, height, width, as little-endian numbers), then the frames one after the
other, each height * width doubles; the file's size tells how many. Rows: video_id, frame, t (frame / rate), sampled (every stride-th frame, from the first), payload.

* A partition is a span of frames of one file. Its reader goes from frame to frame by offset. Files that no span could divide, as their size in the
  folder's listing tells, go together in bundles; they are opened by the tasks alone, and each is read in one piece.
* Filters on `sampled`, `frame`, `t` and `video_id` are pushed: with `sampled = true` a reader steps by the stride, so that frames in between are
  not read; bounds of frame and time shorten or drop spans; a video that is not asked for is not opened. Spark pushes filters if
  spark.sql.python.filterPushdown.enabled is true; it checks all but `sampled = true` again, and all of them where it doesn't push.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tidemark.sources import folders

MAGIC, HEADER = b"TDMKFRM1", "<8sdqq"
HEADER_BYTES = struct.calcsize(HEADER)
SCHEMA = "video_id string, frame long, t double, sampled boolean, payload array<double>"


def stride_of(rate: float, target: float) -> int:
    """Every how many-th frame is sampled; a rate that is missing, NaN or not positive counts as 25."""
    rate = rate if rate is not None and rate == rate and rate > 0 else 25.0
    return max(1, round(rate / target))


@dataclass
class Header:
    rate: float
    frames: int
    height: int
    width: int

    @classmethod
    def read(cls, file) -> Header:
        return cls.of(file.read(HEADER_BYTES), file.size())

    @classmethod
    def of(cls, raw: bytes, size: int) -> Header:
        if len(raw) != HEADER_BYTES or raw[:8] != MAGIC:
            raise ValueError("no container of frames")
        _, rate, height, width = struct.unpack(HEADER, raw)
        frames = (size - HEADER_BYTES) // (8 * height * width) if height * width > 0 else 0
        return cls(rate if rate == rate and rate > 0 else 25.0, frames, height, width)

    @property
    def duration(self) -> float:
        return self.frames / self.rate


@dataclass
class Span(InputPartition):
    path: str
    video: str
    first: int
    end: int
    only_sampled: bool

    def __init__(self, path: str, video: str, first: int, end: int, only_sampled: bool):
        super().__init__(None)
        self.path, self.video, self.first, self.end, self.only_sampled = path, video, first, end, only_sampled


@dataclass
class Bundle(InputPartition):
    """Small files of one folder, by name."""

    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(None)
        self.names = names


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return folders.store_of(folder)


def _listed(folder: str) -> tuple[fs.FileSystem, list[tuple[str, str, int]]]:
    """The store of a folder and the containers in it: path, video and size, by name."""
    store, base = _store(folder)
    files = store.get_file_info(fs.FileSelector(base))
    return store, sorted((f.path, f.base_name.rpartition(".")[0], f.size) for f in files if f.is_file and f.extension == "frames")


class PlainReader(DataSourceReader):
    """Reads all frames; Spark filters them."""

    def __init__(self, folder: str, target: float, span: int):
        self.folder, self.target, self.span = folder, target, span
        self.only_sampled, self.videos = False, None
        self.low, self.high = {"frame": -math.inf, "t": -math.inf}, {"frame": math.inf, "t": math.inf}

    def partitions(self) -> list[InputPartition]:
        store, files = _listed(self.folder)
        out, small = [], []
        for path, video, size in files:
            if self.videos is not None and video not in self.videos:
                continue
            if size <= HEADER_BYTES + 8 * self.span:  # a frame has a cell of 8 bytes at least
                small.append(video)
                continue
            with store.open_input_file(path) as file:
                first, end = self._bounds(Header.read(file))
            out += [Span(path, video, a, min(end, a + self.span), self.only_sampled) for a in range(first, end, self.span)]
        each = max(32, min(1024, len(small) // 64))
        return out + [Bundle(small[a : a + each]) for a in range(0, len(small), each)]

    def _bounds(self, header: Header) -> tuple[int, int]:
        """The first frame that the filters leave, and the one after the last; equal, where they leave none."""
        first = max(0, self.low["frame"], (self.low["t"] * header.rate) - 1)
        end = min(header.frames, self.high["frame"] + 1, (self.high["t"] * header.rate) + 2)
        return (math.floor(first), math.ceil(end)) if first < end else (0, 0)

    def _read_bundle(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        store, base = _store(self.folder)
        columns: list[list] = [[], [], [], [], []]
        rows = 0

        def batch() -> pa.RecordBatch:
            lengths, values = (np.concatenate([x[i] for x in columns[4]]) for i in (0, 1))
            payload = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, pa.float64()))
            video = pa.array(np.repeat(np.array(columns[0], object), [len(x) for x in columns[1]]), pa.string())
            return pa.RecordBatch.from_arrays([video, *(pa.array(np.concatenate(c)) for c in columns[1:4]), payload], ["video_id", "frame", "t", "sampled", "payload"])

        for video in names:
            with store.open_input_file(f"{base}/{video}.frames") as file:
                raw = file.read()
            header = Header.of(raw[:HEADER_BYTES], len(raw))
            stride, size = stride_of(header.rate, self.target), header.height * header.width
            step = stride if self.only_sampled else 1
            first, end = self._bounds(header)
            at = np.arange(-(-first // step) * step, end, step)
            if not len(at):
                continue
            cells = np.frombuffer(raw, "<f8", header.frames * size, HEADER_BYTES).reshape(header.frames, size)[at]
            for column, values in zip(columns, (video, at, at / header.rate, at % stride == 0, (np.full(len(at), size), cells.ravel())), strict=True):
                column.append(values)
            rows += len(at)
            if rows >= 4096:
                yield batch()
                columns, rows = [[], [], [], [], []], 0
        if rows:
            yield batch()

    def read(self, partition: Span | Bundle | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads so where there is no span
            return
        if isinstance(partition, Bundle):
            yield from self._read_bundle(partition.names)
            return
        store, _ = _store(self.folder)
        with store.open_input_file(partition.path) as file:
            header = Header.read(file)
            stride, size = stride_of(header.rate, self.target), header.height * header.width
            step = stride if partition.only_sampled else 1
            first = -(-partition.first // step) * step
            for a in range(first, partition.end, 256 * step):
                at = np.arange(a, min(partition.end, a + 256 * step), step)
                frames = []
                for i in at.tolist():
                    file.seek(HEADER_BYTES + 8 * size * i)
                    frames.append(np.frombuffer(file.read(8 * size), "<f8"))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.video] * len(at)), pa.array(at, pa.int64()), pa.array(at / header.rate), pa.array(at % stride == 0), pa.array(frames, pa.list_(pa.float64()))],
                        ["video_id", "frame", "t", "sampled", "payload"],
                    )


class FrameReader(PlainReader):
    """Reads what filters leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what shortens the work; yields what Spark is to check again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name == "sampled" and f.value is True:
                self.only_sampled = True
                continue
            if isinstance(f, IsNotNull):  # no column has nulls
                continue
            if isinstance(f, EqualTo | In) and name == "video_id":
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = wanted if self.videos is None else self.videos & wanted
            elif name in self.low:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low[name] = max(self.low[name], f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high[name] = min(self.high[name], f.value)
            yield f


class Frames(DataSource):
    """Options: path, a folder of *.frames files in any store that pyarrow opens; target, the sampling rate (2); span, frames of a partition (4096)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlainReader:
        kind = FrameReader if self.options.get("push", "false") == "true" else PlainReader
        return kind(self.options["path"], float(self.options.get("target", 2.0)), int(self.options.get("span", 4096)))


def read_frames(spark: SparkSession, folder: str, target: float = 2.0, span: int = 4096) -> DataFrame:
    """The frames of all containers in a folder; filters reach the reader if the session pushes them when this is called and when the plan is made."""
    spark.dataSource.register(Frames)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tidemark_frames").option("target", target).option("span", span).option("push", push).load(folder)


def video_durations(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, duration of every container, from its header alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            found = []
            for video in batch.column("video_id").to_pylist():
                with store.open_input_file(f"{base}/{video}.frames") as file:
                    found.append(Header.read(file).duration)
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), pa.array(found, pa.float64())], ["video_id", "duration"])

    listed = folders.below(spark, folder, deep=False).where(F.endswith("rel", F.lit(".frames")))
    listed = listed.select(F.expr("left(rel, length(rel) - 7)").alias("video_id"))
    return listed.repartition(folders.tasks_for(spark, listed.count())).mapInArrow(run, "video_id string, duration double")


def write_containers(frames: DataFrame, folder: str, rate: float = 10.0) -> None:
    """Writes `frames` (video_id, t, event_id, value) as containers of one cell, a file for each video, in order of t and event_id.

    A video streams into its file, which appears under its name when it is whole, so that a repeated task replaces what a lost one has written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, part, last = None, "", None
        for batch in batches:
            names, values = batch.column("video_id").to_numpy(zero_copy_only=False), batch.column("value").to_numpy(zero_copy_only=False).astype("<f8")
            begin = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, int)
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(names)).tolist(), strict=True):
                video = names[a]
                if video != last:
                    if out is not None:
                        out.close()
                        store.move(part, f"{base}/{last}.frames")
                    last, part = video, f"{base}/{video}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(part)
                    out.write(struct.pack(HEADER, MAGIC, rate, 1, 1))
                out.write(values[a:b].tobytes())
        if out is not None:
            out.close()
            store.move(part, f"{base}/{last}.frames")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["video_id"])

    dealt = frames.repartition("video_id").sortWithinPartitions("video_id", "t", "event_id")
    dealt.select(dealt["video_id"].cast("string").alias("video_id"), dealt["value"].cast("double").alias("value")).mapInArrow(run, "video_id string").write.format("noop").mode("overwrite").save()
