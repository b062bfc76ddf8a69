"""Fan-out of stream messages: a sink that logs each micro-batch as a whole, and subscribers with an offset each.

* Tasks write their messages as part files; the commit of a micro-batch names them in one manifest, under the batch's number. What a lost or
  failed task has written is in no manifest, and a batch that runs again replaces its manifest: no message is lost or there twice.
* A subscriber has an offset, the last batch that it took whole, kept beside the log. `deliver` hands each what it has not had, in order. A
  subscriber that raises is evicted, with the reason, also for later runs; the others go on. It may be admitted again, and goes on where it was.
* A message has its batch and place. A driver that is lost between a delivery and its offset repeats that batch to that subscriber, which
  can tell by these numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

Subscriber = Callable[[list[dict]], None]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _put(store: fs.FileSystem, path: str, value: object) -> None:
    """Writes a small JSON file that appears whole."""
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(value).encode())
    store.move(part, path)


def _get(store: fs.FileSystem, path: str) -> dict | None:
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class LogWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Part:
        """A task's rows (one column, message) as lines of a part file."""
        store, base = _store(self.folder)
        store.create_dir(f"{base}/parts", recursive=True)
        name, n = f"parts/{uuid.uuid4().hex}", 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for row in iterator:
                out.write(json.dumps(row["message"]).encode() + b"\n")
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        store, base = _store(self.folder)
        store.create_dir(f"{base}/batches", recursive=True)
        before = _get(store, f"{base}/batches/{batchId:012d}")
        _put(store, f"{base}/batches/{batchId:012d}", {"batch": batchId, "parts": [[p.path, p.rows] for p in messages if p and p.rows]})
        self._drop([p[0] for p in (before or {"parts": []})["parts"]] + [p.path for p in messages if p and not p.rows])

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self._drop([p.path for p in messages if p])

    def _drop(self, names: list[str]) -> None:
        store, base = _store(self.folder)
        for name in names:
            if store.get_file_info(f"{base}/{name}").is_file:
                store.delete_file(f"{base}/{name}")


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:  # noqa: N802
        return LogWriter(self.options["path"])


def log(stream: DataFrame, folder: str, checkpoint: str, kind: str = "score"):
    """Starts a query that logs each row of `stream` as a message: JSON with its type and data."""
    stream.sparkSession.dataSource.register(MessageLog)
    message = F.to_json(F.struct(F.lit(kind).alias("type"), F.struct("*").alias("data")), {"ignoreNullFields": "false"})
    return stream.select(message.alias("message")).writeStream.format("tidemark_log").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _batches(store: fs.FileSystem, base: str) -> list[int]:
    if store.get_file_info(f"{base}/batches").type == fs.FileType.NotFound:
        return []
    return sorted(int(f.base_name) for f in store.get_file_info(fs.FileSelector(f"{base}/batches")) if f.base_name.isdigit())


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """batch, place (from 0), message of all that is committed: one row for each message."""
    store, base = _store(folder)
    parts = []
    for batch in _batches(store, base):
        start = 0
        for path, rows in _get(store, f"{base}/batches/{batch:012d}")["parts"]:
            parts.append((batch, start, f"{base}/{path}"))
            start += rows

    def read(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            for batch, start, path in zip(*(frame.column(c).to_pylist() for c in ("batch", "start", "path")), strict=True):
                with store.open_input_stream(path) as file:
                    lines = file.read().decode().splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(lines), pa.int64()), pa.array(range(start, start + len(lines)), pa.int64()), pa.array([json.loads(x) for x in lines], pa.string())], ["batch", "place", "message"])

    listed = spark.createDataFrame(parts, "batch long, start long, path string").repartition(max(1, min(len(parts), 200)))
    return listed.mapInArrow(read, "batch long, place long, message string")


class FanOut:
    """The subscribers of a log."""

    def __init__(self, folder: str):
        self.store, self.base = _store(folder)
        self.store.create_dir(f"{self.base}/subscribers", recursive=True)

    def state(self, name: str) -> dict:
        """next: the batch that the subscriber is to get next; dead: why it was evicted, or null."""
        return _get(self.store, f"{self.base}/subscribers/{name}") or {"next": 0, "dead": None}

    def admit(self, name: str) -> None:
        """Lets an evicted subscriber go on where it was."""
        _put(self.store, f"{self.base}/subscribers/{name}", {**self.state(name), "dead": None})

    def deliver(self, subscribers: dict[str, Subscriber], most: int = 1000) -> dict[str, int]:
        """Hands every subscriber the batches it has not had, in lists of at most `most` messages; how many messages each took whole batches of."""
        taken = dict.fromkeys(subscribers, 0)
        for name, send in subscribers.items():
            state = self.state(name)
            for batch in [b for b in _batches(self.store, self.base) if b >= state["next"]] if state["dead"] is None else []:
                try:
                    taken[name] += self._send(batch, send, most)
                except Exception as why:  # noqa: BLE001  whatever a subscriber raises is its end, not the others'
                    _put(self.store, f"{self.base}/subscribers/{name}", {"next": batch, "dead": repr(why)[:500]})
                    break
                _put(self.store, f"{self.base}/subscribers/{name}", {"next": batch + 1, "dead": None})
        return taken

    def _send(self, batch: int, send: Subscriber, most: int) -> int:
        place, held = 0, []
        for path, _ in _get(self.store, f"{self.base}/batches/{batch:012d}")["parts"]:
            with self.store.open_input_stream(f"{self.base}/{path}") as file:
                for line in file.read().decode().splitlines():
                    held.append({"batch": batch, "place": place, **json.loads(json.loads(line))})
                    place += 1
                    if len(held) == most:
                        send(held)
                        held = []
        if held:
            send(held)
        return place
